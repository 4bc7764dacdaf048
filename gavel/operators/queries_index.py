"""Queries on the stored search index with their DuckDB twins, which read the texts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from gavel.operators import postings, search
from gavel.operators.queries_search import MEETINGS, meetings
from gavel.plans import tables
from gavel.plans.bridge import Tables, twin

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Indexes by application and directory of tables: the first query that needs one builds it.
_built: dict[tuple[str, str], str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = twin(sql)
        return f

    return add


def index(t: Tables) -> str:
    """The folder of the index of all meeting documents, on their events' names, contents and organizations."""
    key = (t._spark.sparkContext.applicationId, t._dir)
    if key not in _built:
        documents = meetings(t).select("id", "db_id", "result_type", "catalog_id", "city", "organization", "meeting_category", "date", "event_name")
        documents = tables.checkpointed(documents)
        same = lambda c: documents.select(F.col(c).alias("unit"), F.col(c).alias("text")).distinct()
        contents = t.catalog.select(F.col("id").alias("unit"), F.substring("content", 1, search.MAX_CONTENT).alias("text"))
        path = tables.new_folder(t._spark, "index")
        postings.build(documents, [postings.Field("event_name", "event_name", same("event_name")), postings.Field("content", "catalog_id", contents), postings.Field("organization", "organization", same("organization"))], path, "content")
        tables.drop(documents)
        _built[key] = path
    return _built[key]


WORDS = "regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{N}}'']+')"
#: Each field's units: how many documents have them, and their words.
UNITS = f"""
m AS MATERIALIZED (SELECT concat('doc_', CAST(id AS VARCHAR)) AS id, id AS db_id, catalog_id, city, organization, meeting_category, date, event_name FROM {MEETINGS} x),
u AS MATERIALIZED (
  SELECT 0 AS field, event_name AS unit, count(*) AS refs, {WORDS.format("event_name")} AS w FROM m GROUP BY event_name
  UNION ALL SELECT 1, CAST(r.catalog_id AS VARCHAR), r.refs, {WORDS.format("substring(c.content, 1, 50000)")} FROM (SELECT catalog_id, count(*) AS refs FROM m GROUP BY 1) r JOIN {{catalog}} c ON c.id = r.catalog_id
  UNION ALL SELECT 2, organization, count(*), {WORDS.format("organization")} FROM m GROUP BY organization)"""


def scored(terms: list[str], where: str = "TRUE") -> str:
    """SQL of UNITS and s: id, matched, field_rank, score of the documents where a condition holds."""
    listed = "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in terms) + "]"
    return f"""
WITH {UNITS},
z AS (SELECT field, (SELECT count(*) FROM m) AS docs, CAST(sum(refs * len(w)) AS DOUBLE) / (SELECT count(*) FROM m) AS avgdl FROM u GROUP BY field),
h AS (SELECT * FROM (SELECT field, unit, refs, len(w) AS dl, term, len(list_filter(w, lambda y: y = term)) AS tf FROM (SELECT *, unnest({listed}) AS term FROM u)) WHERE tf > 0),
n AS (SELECT field, term, sum(refs) AS df FROM h GROUP BY ALL),
b AS (SELECT field, unit, term, ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS s FROM h JOIN n USING (field, term) JOIN z USING (field)),
k AS (SELECT id, 0 AS field, event_name AS unit FROM m WHERE {where} UNION ALL SELECT id, 1, CAST(catalog_id AS VARCHAR) FROM m WHERE {where} UNION ALL SELECT id, 2, organization FROM m WHERE {where}),
s AS (SELECT id, count(DISTINCT term) AS matched, CAST(min(field) AS INTEGER) AS field_rank, round(sum(s), 6) AS score FROM k JOIN b USING (field, unit) GROUP BY id)"""


@query(scored(["building", "the", "urgent"]) + " SELECT id, matched, field_rank, score FROM s ORDER BY matched DESC, field_rank, score DESC, id LIMIT 20")
def w3_lexical_search(t):
    return postings.search(t._spark, index(t), "building urgent the").select("id", "matched", "field_rank", "score")


WHERE = "city = 'nation_6' AND organization = 'BUILDING' AND date >= '1996-01-01' AND date <= '1999-12-31'"
HIT = "list_has_any(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}'']+'), ['the', 'und'])"


@query(
    scored(["the", "und"], WHERE)
    + f""", p AS (SELECT s.id, m.date, m.catalog_id, matched, score FROM s JOIN m USING (id) ORDER BY m.date DESC, s.id LIMIT 20 OFFSET 20),
q AS (SELECT p.*, list_filter(regexp_split_to_array(substring(c.content, 1, 50000), '\\s+'), lambda x: x <> '') AS w FROM p LEFT JOIN {{catalog}} c ON c.id = p.catalog_id),
a AS (SELECT *, coalesce(list_min(list_filter(list_transform(w, lambda x, i: CASE WHEN {HIT.format("x")} THEN i - 1 END), lambda i: i IS NOT NULL)), 0) AS f FROM q)
SELECT id, date, matched, score, array_to_string(list_transform(w[greatest(0, f - 25) + 1:greatest(0, f - 25) + 50], lambda x: CASE WHEN {HIT.format("x")} THEN concat('<b>', x, '</b>') ELSE x END), ' ') AS snippet FROM a"""
)
def w3_filtered_search(t):
    asked = search.SearchFilters(city="nation_6", organization="BUILDING", date_from=dt.date(1996, 1, 1), date_to=dt.date(1999, 12, 31))
    page = postings.search(t._spark, index(t), "the und", asked, "newest", 20, 20)
    return postings.highlighted(page, index(t), "the und", 1, pre="<b>", post="</b>").select("id", "date", "matched", "score", "snippet")


@query("WITH " + UNITS + " SELECT field, term, count(*) AS units, CAST(sum(refs) AS BIGINT) AS documents, count(DISTINCT unit) AS texts FROM (SELECT DISTINCT field, unit, refs, unnest(w) AS term FROM u) x GROUP BY ALL")
def w3_postings(t):
    stored = t._spark.read.parquet(f"{index(t)}/postings")
    # the index has each unit and term once
    return stored.groupBy("field", "term").agg(F.count("*").alias("units"), F.sum("refs").alias("documents"), F.count("unit").alias("texts"))
