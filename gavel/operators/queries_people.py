"""Queries of people, links, onboarding, keywords and streaming twins with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from gavel.functions import text as X
from gavel.operators import people, runs, topics
from gavel.operators.queries_search import KIND, star
from gavel.plans.bridge import Tables, twin
from gavel.streaming import jobs

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = twin(sql)
        return f

    return add


def membership(t: Tables):
    s = F.col("s_suppkey")
    return t.supplier.select(
        (s + 1).alias("person_id"),
        (F.col("s_nationkey") + 1).alias("place_id"),
        F.when(s % 4 == 0, F.concat(F.lit("client"), (F.col("s_nationkey") + 1).cast("string"))).otherwise(F.concat(F.lit("client"), F.col("s_nationkey").cast("string"))).alias("client"),
        F.when(s % 2 == 0, "City Council").otherwise("Parks").alias("body"),
        F.when(s % 5 != 0, "minutes").alias("evidence"),
        F.when(s % 3 == 0, "Chair").alias("label"),
        F.date_add(F.lit("2020-01-01").cast("date"), (s % 900).cast("int")).alias("start"),
    )


@query("SELECT id, name FROM {person} p WHERE EXISTS (SELECT 1 FROM {supplier} s WHERE s.s_suppkey + 1 = p.id AND s_suppkey % 4 <> 0 AND s_suppkey % 5 <> 0 AND s_suppkey % 2 = 0 AND s_nationkey % 2 = 0)")
def j4_authorized_people(t):
    bodies = t.place.filter("id % 2 = 1").select(F.col("name").alias("slug"), F.lit("CITY council").alias("body"))
    return people.authorized_people(t.person, membership(t), t.place, bodies).select("id", "name")


@query("SELECT s_suppkey + 1 AS person_id, concat_ws('|', CAST(CAST(DATE '2020-01-01' + CAST(s_suppkey % 900 AS INTEGER) AS DATE) AS VARCHAR), CASE WHEN s_suppkey % 2 = 0 THEN 'City Council' ELSE 'Parks' END, concat('Nation ', CAST(s_nationkey AS VARCHAR)), CASE WHEN s_suppkey % 3 = 0 THEN 'Chair' ELSE 'Member' END) AS roles FROM {supplier}")
def j5_role_history(t):
    return people.role_history(membership(t), t.place)


@query("SELECT id, CASE WHEN id % 7 = 0 THEN 'delete' WHEN id % 11 = 0 THEN 'update' ELSE 'same' END AS change FROM {person} UNION ALL SELECT id + 1000000, 'insert' FROM {person} WHERE id % 13 = 0")
def u4_reconcile_roster(t):
    p = t.person.select("id", "name", "client")
    snapshot = p.filter("id % 7 <> 0").select("id", F.when(F.col("id") % 11 == 0, F.upper("name")).otherwise(F.col("name")).alias("name"), "client")
    snapshot = snapshot.union(p.filter("id % 13 = 0").select(F.col("id") + 1000000, "name", "client"))
    return people.reconcile_roster(p, snapshot, ["id"], ["name", "client"])


STAGED = "(SELECT l_orderkey * 100 + min(l_linenumber) AS id, l_orderkey + CASE WHEN l_orderkey % 9 = 0 THEN 100000000 ELSE 0 END AS o, l_partkey AS h FROM {lineitem} GROUP BY l_orderkey, l_partkey)"


@query("WITH s AS " + STAGED + ", e AS (SELECT s.id, s.h, v.first AS event_id FROM s LEFT JOIN {event} x ON x.id = s.o + 1 LEFT JOIN (SELECT ocd_division_id, record_date, name, min(id) AS first FROM {event} y GROUP BY 1, 2, 3) v ON v.ocd_division_id = x.ocd_division_id AND v.record_date = x.record_date AND v.name = x.name), f AS (SELECT e.*, c.id AS catalog_id, row_number() OVER (PARTITION BY h, e.event_id IS NULL ORDER BY e.id) AS nth, row_number() OVER (PARTITION BY h, e.event_id ORDER BY e.id) AS again FROM e LEFT JOIN (SELECT id FROM {catalog} k WHERE id % 2 = 0) c ON c.id = e.h + 1) SELECT f.id, CASE WHEN f.event_id IS NULL THEN 'no_event' WHEN again > 1 OR EXISTS (SELECT 1 FROM {document} d WHERE d.event_id = f.event_id AND d.catalog_id = f.catalog_id AND d.id % 3 = 0) THEN 'known' WHEN f.catalog_id IS NOT NULL OR nth > 1 THEN 'linked' ELSE 'new' END AS outcome FROM f")
def j9_link_staged_urls(t):
    staged = t.lineitem.groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("n")).select((F.col("l_orderkey") * 100 + F.col("n")).alias("id"), (F.col("l_orderkey") + F.when(F.col("l_orderkey") % 9 == 0, 100000000).otherwise(0) + 1).alias("o"), F.col("l_partkey").cast("string").alias("url_hash"))
    own = t.event.select(F.col("id").alias("o"), "ocd_division_id", "record_date", "name")
    staged = staged.join(own, "o", "left").select("id", "url_hash", "ocd_division_id", "record_date", "name")
    catalog = t.catalog.select("id", F.when(F.col("id") % 2 == 0, (F.col("id") - 1).cast("string")).otherwise(F.concat(F.lit("other "), F.col("id").cast("string"))).alias("url_hash"))
    return people.link_staged_urls(staged, t.event, catalog, t.document.withColumn("event_id", F.when(F.col("id") % 3 == 0, F.col("event_id")).otherwise(-F.col("event_id"))))


@query("SELECT c.id AS catalog_id, CASE WHEN e.vec_id IS NULL THEN 'missing' WHEN e.vec_id % 2 = 0 THEN 'fresh' ELSE 'stale' END AS state FROM {catalog} c LEFT JOIN {embeddings} e ON e.vec_id + 1 = c.id WHERE coalesce(c.summary, '') <> ''")
def j8_embedding_freshness(t):
    hashes = t.catalog.select(F.col("id").alias("catalog_id"), F.sha2("summary", 256).alias("h"))
    stored = t.embeddings.select((F.col("vec_id") + 1).alias("catalog_id"), "vec_id").join(hashes, "catalog_id").select("catalog_id", F.lit("driver").alias("model_name"), F.when(F.col("vec_id") % 2 == 0, F.col("h")).otherwise("old").alias("source_hash"))
    return people.embedding_freshness(t.catalog, stored, "driver")


COUNTS = "(SELECT city, count(*) AS catalogs, count(*) FILTER (agenda) AS agendas, count(*) FILTER (filled) AS non_empty, count(*) FILTER (agenda AND segmented) AS segmented FROM (SELECT p.name AS city, d.catalog_id, bool_or(" + KIND.format("d.category") + " = 'agenda') AS agenda, bool_or(coalesce(c.content, '') <> '') AS filled, bool_or(coalesce(c.agenda_segmentation_status IN ('complete', 'empty'), false)) AS segmented FROM {document} d JOIN {event} e ON e.id = d.event_id JOIN {place} p ON p.id = e.place_id JOIN {catalog} c ON c.id = d.catalog_id GROUP BY 1, 2) k GROUP BY 1)"


def counts(t: Tables):
    return people.onboarding_counts(star(t).withColumn("kind", X.document_kind(F.col("category"))))


@query("SELECT city, catalogs, agendas, non_empty, segmented FROM " + COUNTS + " c")
def a5_onboarding_counts(t):
    return counts(t)


@query("WITH r AS (SELECT *, round(non_empty / nullif(catalogs, 0), 6) AS content_rate, round(segmented / nullif(agendas, 0), 6) AS segmentation_rate FROM " + COUNTS + " c) SELECT city, content_rate, segmentation_rate, concat_ws(',', CASE WHEN content_rate < 0.9 THEN 'content' END, CASE WHEN segmentation_rate < 0.95 THEN 'segmentation' END) AS failed, CASE WHEN catalogs = 0 OR agendas = 0 THEN 'insufficient_data' WHEN coalesce(content_rate >= 0.9, true) AND coalesce(segmentation_rate >= 0.95, true) THEN 'pass' ELSE 'fail' END AS verdict FROM r")
def a6_onboarding_gate(t):
    return people.onboarding_gate(counts(t)).select("city", "content_rate", "segmentation_rate", "failed", "verdict")


STOP = ", ".join(f"'{w}'" for w in topics.STOP_WORDS)
TFIDF = "WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{3,}'), lambda x: x NOT IN (" + STOP + ")) AS w FROM {documents}), t AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1])))) AS term FROM w), tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2), v AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY 1 HAVING count(*) <= 0.8 * (SELECT count(*) FROM {documents}) ORDER BY total DESC, term LIMIT 5000), x AS (SELECT doc_id, term, tf * (ln((1 + (SELECT count(*) FROM {documents})) / (1 + df)) + 1) AS w FROM tf JOIN v USING (term)), s AS (SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM x) "


@query(TFIDF + "SELECT doc_id, term, weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) AS rank FROM s) r WHERE rank <= 5")
def x10_tfidf_keywords(t):
    return topics.keywords(t.documents)


@query("SELECT CAST(time_bucket(INTERVAL 5 MINUTE, ts) AS VARCHAR) AS start, phase, coalesce(" + ", ".join(f"CASE WHEN duration_s <= {b} THEN {b} END" for b in runs.BUCKETS) + ", -1) AS le, count(*) AS n FROM {span} GROUP BY 1, 2, 3")
def m2_phase_buckets(t):
    d = jobs.phase_buckets(t.span)
    return d.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "phase", F.when(F.col("le") == float("inf"), -1.0).otherwise(F.col("le")).alias("le"), "n")


@query("SELECT event_id AS task_id, event_id % 5 NOT IN (0, 1, 2) AS finished FROM {events}")
def m3_paired(t):
    e = t.events.select(F.col("event_id").alias("task_id"), F.lit(0).alias("retry"), "ts")
    k = F.col("task_id") % 5
    # another retry's end, an end before the dispatch, one after the timeout, or one in time
    ends = e.select("task_id", F.when(k == 0, 1).otherwise(0).alias("retry"), F.when(k == 1, F.col("ts") - F.expr("INTERVAL 1 MINUTE")).when(k == 2, F.col("ts") + F.expr("INTERVAL 90 MINUTES")).otherwise(F.col("ts") + F.expr("INTERVAL 5 MINUTES")).alias("ts"))
    d = jobs.paired(e, ends)
    return d.select("task_id", F.col("finished_at").isNotNull().alias("finished"))
