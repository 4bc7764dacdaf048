"""Queries of search, trends, graph and vectors with their DuckDB twins."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from gavel.functions import text as X
from gavel.operators import graph, search
from gavel.plans import tables
from gavel.plans.bridge import Tables, from_sql, twin

NOISE = ", ".join(f"'{t}'" for t in X.TREND_NOISE)
CATEGORY = "CASE WHEN lower({0}) LIKE '%regular%' THEN 'Regular' WHEN lower({0}) LIKE '%special%' THEN 'Special' WHEN lower({0}) LIKE '%closed%' THEN 'Closed' ELSE 'Other' END"
KIND = "CASE WHEN lower(coalesce({0}, '')) IN ('agenda', 'agenda_html') THEN 'agenda' WHEN lower(coalesce({0}, '')) = 'minutes' THEN 'minutes' ELSE 'unknown' END"
STAR = "(SELECT d.id, d.event_id, d.catalog_id, d.category, e.record_date, e.name AS event_name, e.meeting_type, p.name AS city, o.name AS organization, c.content, c.summary, c.topics FROM {document} d JOIN {event} e ON e.id = d.event_id JOIN {place} p ON p.id = e.place_id LEFT JOIN {organization} o ON o.id = e.organization_id JOIN {catalog} c ON c.id = d.catalog_id)"
MEETINGS = "(SELECT id, catalog_id, event_id, city, coalesce(organization, 'City Council') AS organization, " + CATEGORY.format("meeting_type") + " AS meeting_category, strftime(record_date, '%Y-%m-%d') AS date, event_name, " + KIND.format("category") + " AS kind, content, topics FROM " + STAR + " s)"
CITIES = ["nation_6", "nation_7", "nation_12"]
PAIRS = "(SELECT a.vec_id AS id, b.vec_id AS neighbour, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 9) AS score FROM {embeddings} a JOIN {embeddings} b ON a.vec_id <> b.vec_id)"
NEAR = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, neighbour) AS n FROM " + PAIRS + " p) q WHERE n <= 3 AND score >= 0.35)"
EDGES = "(SELECT least(id, neighbour) AS a, greatest(id, neighbour) AS b, CASE WHEN count(*) = 2 THEN 1.0 ELSE 0.5 END AS confidence FROM " + NEAR + " k GROUP BY 1, 2)"

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, raw: bool = False):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql if raw else twin(sql)
        return f

    return add


def star(t: Tables):
    return search.meeting_star(t.document, t.catalog, t.event, t.place, t.organization)


def meetings(t: Tables):
    return search.meeting_documents(star(t))


@query("SELECT id, event_id, catalog_id, city, organization, CAST(record_date AS VARCHAR) AS record_date, category FROM " + STAR + " s")
def j1_meeting_star(t):
    return star(t).select("id", "event_id", "catalog_id", "city", "organization", F.col("record_date").cast("string").alias("record_date"), "category")


@query("WITH first AS (SELECT catalog_id, min_by(event_id, id) AS event_id FROM {document} GROUP BY 1) SELECT i.id, i.catalog_id, e.id AS event_id, p.name AS city, o.name AS organization, i.page_number FROM {agenda_item} i JOIN first f ON f.catalog_id = i.catalog_id JOIN {event} e ON e.id = f.event_id JOIN {place} p ON p.id = e.place_id LEFT JOIN {organization} o ON o.id = e.organization_id")
def j2_item_star(t):
    return search.item_star(t.agenda_item, t.document, t.event, t.place, t.organization).select("id", "catalog_id", "event_id", "city", "organization", "page_number")


@query("SELECT concat('doc_', CAST(id AS VARCHAR)) AS id, id AS db_id, 'meeting' AS result_type, city, organization, meeting_category, date, kind, CASE WHEN content <> '' THEN substring(content, 1, 50000) END AS content, coalesce(length(content), 0) > 50000 AS content_truncated, CAST(coalesce(length(content), 0) AS BIGINT) AS original_chars FROM " + MEETINGS + " m")
def f4_meeting_documents(t):
    return meetings(t).select("id", "db_id", "result_type", "city", "organization", "meeting_category", "date", "kind", "content", "content_truncated", "original_chars")


@query("SELECT concat('item_', CAST(id AS VARCHAR)) AS id, CASE WHEN title LIKE '%<%' OR title LIKE '%>%' THEN trim(regexp_replace(title, '<[^>]+>', ' ', 'g')) ELSE title END AS title FROM {agenda_item}")
def f5_item_documents(t):
    return t.agenda_item.select(F.concat(F.lit("item_"), F.col("id").cast("string")).alias("id"), X.html_stripped(F.col("title")).alias("title"))


@query("SELECT result_type, id FROM (SELECT 'meeting' AS result_type, concat('doc_', CAST(id AS VARCHAR)) AS id FROM " + STAR + " s UNION ALL SELECT 'agenda_item', concat('item_', CAST(i.id AS VARCHAR)) FROM {agenda_item} i WHERE EXISTS (SELECT 1 FROM {document} d JOIN {event} e ON e.id = d.event_id WHERE d.catalog_id = i.catalog_id)) u")
def s10_search_table(t):
    items = search.item_documents(search.item_star(t.agenda_item, t.document, t.event, t.place, t.organization))
    return search.search_table(meetings(t), items).select("result_type", "id")


@query("SELECT id FROM " + MEETINGS + " m WHERE city = 'nation_6' AND date >= '1997-01-01' AND date <= '1998-12-31'")
def f2_filters(t):
    return meetings(t).filter(search.SearchFilters(city="nation_6", date_from=dt.date(1997, 1, 1), date_to=dt.date(1998, 12, 31)).predicate()).select(F.col("db_id").alias("id"))


@query("SELECT id FROM " + MEETINGS + " m WHERE lower(city) = 'nation_6' AND lower(organization) = 'building' AND date >= '1997-01-01'")
def f3_candidate_matcher(t):
    return meetings(t).filter(search.SearchFilters(city="NATION_6", organization="Building", date_from=dt.date(1997, 1, 1)).matcher()).select(F.col("db_id").alias("id"))


TYPES = "(SELECT id, concat(meeting_type, CASE id % 5 WHEN 0 THEN ' Regular' WHEN 1 THEN ' SPECIAL meeting' WHEN 2 THEN ' closed regular' ELSE '' END) AS meeting_type FROM {event} e)"


@query("SELECT id, " + CATEGORY.format("meeting_type") + " AS meeting_category FROM " + TYPES + " e")
def f6_meeting_category(t):
    return from_sql(t, "SELECT * FROM " + TYPES + " e").select("id", X.meeting_category(F.col("meeting_type")).alias("meeting_category"))


@query("SELECT id, " + KIND.format("category") + " AS kind FROM {document}")
def f7_document_kind(t):
    return t.document.select("id", X.document_kind(F.col("category")).alias("kind"))


NAMES = "(SELECT id, CASE id % 7 WHEN 0 THEN 'San José' WHEN 1 THEN ' El-Paso  Nuevo ' WHEN 2 THEN 'TX_Waco' WHEN 3 THEN 'bad!name' WHEN 4 THEN 'la mesa' WHEN 5 THEN NULL ELSE name END AS name FROM {place} p)"


@query("SELECT id, CASE WHEN regexp_matches(l, '^[a-z0-9_\\-\\s]+$') THEN CASE WHEN regexp_matches(s, '^[a-z]{2}_.+') THEN s ELSE concat('ca_', s) END END AS slug FROM (SELECT id, l, regexp_replace(l, '[\\s-]+', '_', 'g') AS s FROM (SELECT id, lower(translate(trim(name), 'áéíóúüñçÁÉÍÓÚÜÑÇ', 'aeiouuncAEIOUUNC')) AS l FROM " + NAMES + " n) k) p")
def f1_city_slug(t):
    return from_sql(t, "SELECT * FROM " + NAMES + " n").select("id", X.city_slug(F.col("name")).alias("slug"))


SOURCES = "(SELECT id, CASE id % 4 WHEN 0 THEN 'san_mateo' WHEN 1 THEN 'san mateo' WHEN 2 THEN 'san leandro' ELSE source END AS source FROM {event} e)"


@query("SELECT id FROM " + SOURCES + " e WHERE source IN ('san_mateo', 'san mateo')")
def f17_city_aliases(t):
    return search.with_aliases(from_sql(t, "SELECT * FROM " + SOURCES + " e"), "san_mateo").select("id")


@query("SELECT facet, value, count(*) AS n FROM (SELECT 'city' AS facet, city AS value FROM " + MEETINGS + " m UNION ALL SELECT 'organization', organization FROM " + MEETINGS + " m UNION ALL SELECT 'meeting_category', meeting_category FROM " + MEETINGS + " m UNION ALL SELECT 'topics', unnest(list_distinct(topics)) FROM " + MEETINGS + " m) f WHERE value IS NOT NULL GROUP BY 1, 2")
def a1_facets(t):
    return search.facets(meetings(t))


@query("SELECT topic, count(*) AS n FROM (SELECT COLLAPSE(topic) AS topic FROM (SELECT unnest(topics) AS topic, date FROM " + MEETINGS + " m) u WHERE date BETWEEN '1996-01-01' AND '1998-06-30') v WHERE topic <> '' AND lower(topic) NOT IN (" + NOISE + ") GROUP BY 1 ORDER BY n DESC, lower(topic), topic LIMIT 20")
def a2_topic_counts(t):
    return search.topic_counts(meetings(t), "1996-01-01", "1998-06-30")


@query("WITH tt AS (SELECT city, CAST(date AS DATE) AS day, unnest(topics) AS topic FROM " + MEETINGS + " m WHERE city IN ('nation_6', 'nation_7', 'nation_12')), top AS (SELECT topic FROM tt WHERE day BETWEEN DATE '1996-02-10' AND DATE '1996-12-20' AND lower(topic) NOT IN (" + NOISE + ") GROUP BY 1 ORDER BY count(*) DESC, lower(topic), topic LIMIT 5), grid AS (SELECT c.city, CAST(b.b AS DATE) AS bucket, top.topic FROM (SELECT unnest(['nation_6', 'nation_7', 'nation_12']) AS city) c, (SELECT unnest(generate_series(TIMESTAMP '1996-01-01', TIMESTAMP '1996-12-20', INTERVAL 3 MONTH)) AS b) b, top) SELECT g.city, CAST(g.bucket AS VARCHAR) AS bucket, g.topic, count(tt.topic) AS n FROM grid g LEFT JOIN tt ON tt.city = g.city AND tt.topic = g.topic AND tt.day >= g.bucket AND tt.day < g.bucket + INTERVAL 3 MONTH AND tt.day <= DATE '1996-12-20' GROUP BY 1, 2, 3")
def a3_trends_compare(t):
    return search.trends_compare(meetings(t), CITIES, "1996-02-10", "1996-12-20", "quarter").withColumn("bucket", F.col("bucket").cast("string"))


@query("SELECT id, city, date FROM " + MEETINGS + " m WHERE city = 'nation_12' ORDER BY date DESC NULLS LAST, id LIMIT 20 OFFSET 20")
def w2_page(t):
    return search.page(meetings(t).filter("city = 'nation_12'").select(F.col("db_id").alias("id"), "city", "date"), "newest", 20, 20)


@query("WITH c AS (SELECT id AS row_id, catalog_id, id AS db_id, (id * 31) % 997 AS score FROM " + MEETINGS + " m) SELECT catalog_id, row_id, CAST(score AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY catalog_id ORDER BY score DESC, row_id) AS n FROM c) r WHERE n = 1")
def w4_best_candidates(t):
    c = meetings(t).select(F.col("db_id").alias("row_id"), "result_type", "catalog_id", "db_id", ((F.col("db_id") * 31) % 997).cast("double").alias("score"))
    return search.best_candidates(c).select("catalog_id", "row_id", "score")


@query("WITH s AS (SELECT vec_id AS catalog_id, (vec_id * 17) % 101 AS score FROM {embeddings}), l AS (SELECT doc_id AS catalog_id, doc_id AS rank FROM {documents}) SELECT catalog_id, CAST(score AS DOUBLE) AS score, 0 AS part FROM s UNION ALL SELECT catalog_id, CAST(-(rank + 1) AS DOUBLE), 1 FROM l WHERE catalog_id NOT IN (SELECT catalog_id FROM s)")
def u9_lexical_fallback(t):
    s = t.embeddings.select(F.col("vec_id").alias("catalog_id"), ((F.col("vec_id") * 17) % 101).cast("double").alias("score"))
    hits = t.documents.select(F.col("doc_id").alias("catalog_id"), F.col("doc_id").alias("rank"))
    return search.with_lexical_fallback(s, hits).select("catalog_id", "score", F.col("place.part").alias("part"))


def vectors(t: Tables):
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


@query("SELECT id, neighbour, round(score, 6) AS score FROM " + NEAR + " n")
def g4_nearest_neighbours(t):
    return graph.nearest_neighbours(vectors(t)).select("id", "neighbour", F.round("score", 6).alias("score"))


@query("SELECT count(*) AS pairs, TRUE AS found, 0 AS wrong FROM " + NEAR + " n")
def g4_approximate_neighbours(t):
    """How many of the exact pairs there are, whether the approximate search finds nine in ten of them, and how many it scores otherwise."""
    exact = graph.nearest_neighbours(vectors(t)).withColumnRenamed("score", "exact")
    both = exact.join(graph.approximate_neighbours(vectors(t)), ["id", "neighbour"], "left")
    return both.agg(F.count("*").alias("pairs"), (F.count("score") >= 0.9 * F.count("*")).alias("found"), F.count_if(F.abs(F.col("score") - F.col("exact")) > 1e-6).cast("int").alias("wrong"))


def related(t: Tables):
    near = graph.nearest_neighbours(vectors(t)).groupBy("id").agg(F.collect_list(F.col("neighbour").cast("string")).alias("related_ids"))
    return tables.checkpointed(vectors(t).select("id").join(near, "id", "left"))


@query("SELECT a, b, confidence FROM " + EDGES + " e")
def g1_related_edges(t):
    return graph.related_edges(related(t))


COMPONENTS = "WITH RECURSIVE e AS (SELECT a, b FROM " + EDGES + " x UNION SELECT b, a FROM " + EDGES + " x), r AS (SELECT vec_id AS id, vec_id AS c FROM {embeddings} UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id), k AS (SELECT id, min(c) AS component FROM r GROUP BY id) "


@query(COMPONENTS + "SELECT id, component FROM k")
def g2_components(t):
    r = related(t)
    return graph.components(r.select("id"), graph.related_edges(r))


@query(COMPONENTS + ", d AS (SELECT a AS id, count(*) AS degree FROM e GROUP BY 1), z AS (SELECT component, count(*) AS size FROM k GROUP BY 1) SELECT k.id AS catalog_id, concat('lin-', CAST(k.component AS VARCHAR)) AS lineage_id, CASE WHEN size <= 1 THEN 0.2 ELSE round(least(1.0, 0.3 + 0.2 * least(coalesce(degree, 0), 3) + 0.1 * least(size - 1, 5)), 3) END AS confidence, size, coalesce(degree, 0) AS degree FROM k JOIN z ON z.component = k.component LEFT JOIN d ON d.id = k.id")
def g3_lineage(t):
    r = related(t)
    return graph.lineage(r.select("id"), graph.related_edges(r))


LINEAGE = COMPONENTS + ", z AS (SELECT component, count(*) AS size FROM k GROUP BY 1), big AS (SELECT component FROM z ORDER BY size DESC, component LIMIT 1)"


@query(LINEAGE + " SELECT s.id, s.event_id, CAST(s.record_date AS VARCHAR) AS date FROM " + STAR + " s JOIN k ON k.id = s.catalog_id JOIN big ON big.component = k.component")
def j3_lineage_timeline(t):
    r = related(t)
    lineage = tables.checkpointed(graph.lineage(r.select("id"), graph.related_edges(r)))
    largest = lineage.orderBy(F.desc("size"), F.substring_index("lineage_id", "-", -1).cast("long")).first()  # the lineage that is asked for
    return search.lineage_timeline(star(t).select("id", "event_id", "catalog_id", "record_date"), lineage, largest.lineage_id, 0.3).select("id", "event_id", F.col("record_date").cast("string").alias("date"))


QVEC = [round(((i * 37) % 64) / 64 - 0.5, 6) for i in range(64)]


@query("SELECT vec_id AS id, round(list_dot_product(CAST(embedding AS DOUBLE[]), " + str(QVEC) + "::DOUBLE[]) / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product(" + str(QVEC) + "::DOUBLE[], " + str(QVEC) + "::DOUBLE[]))), 6) AS score FROM {embeddings} ORDER BY score DESC, id LIMIT 10")
def g5_vector_top_k(t):
    return graph.vector_top_k(vectors(t), QVEC)
