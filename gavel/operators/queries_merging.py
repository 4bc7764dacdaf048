"""Queries of scans, merges, city removal, diagnostics and baselines with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from gavel.operators import merging
from gavel.plans.bridge import Tables, twin
from gavel.sources import text_scans

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = twin(sql)
        return f

    return add


@query("SELECT id, name FROM {person} WHERE id % 3 = 0 AND id % 2 = 0")
def s6_manifest(t):
    line = F.when(F.col("id") % 2 == 0, F.concat(F.col("id").cast("string"), F.lit("  # kept"))).otherwise(F.concat(F.lit("# "), F.col("id").cast("string")))
    ids = text_scans.manifest_ids(t.person.filter("id % 3 = 0").select(F.explode(F.array(line, F.lit("x1"), line)).alias("value")))
    return text_scans.in_manifest(t.person, ids, "id").select("id", "name")


@query("SELECT u.name, CASE u.name WHEN 'user' THEN user_id WHEN 'n' THEN event_id END AS value FROM (SELECT * FROM {events} WHERE event_type = 'click' ORDER BY event_id DESC LIMIT 1) e, (SELECT unnest(['user', 'n', 'bad']) AS name) u")
def s5_latest_counters(t):
    line = F.concat(F.lit("INFO "), "event_type", F.lit(" user="), F.col("user_id").cast("string"), F.lit(", n="), F.col("event_id").cast("string"), F.lit(" bad=1.5s"))
    return text_scans.latest_counters(t.events.select(F.col("event_id").alias("line_no"), line.alias("value")), "click")


PORTAL = "(SELECT catalog_id, item_order, CASE WHEN item_order % 2 = 0 THEN lower(title) ELSE concat(title, '!') END AS title FROM {agenda_item} WHERE catalog_id % 4 = 0 OR item_order < 2)"


@query("WITH p AS " + PORTAL + ", big AS (SELECT catalog_id FROM p GROUP BY 1 HAVING count(*) >= 3), u AS (SELECT catalog_id, item_order, title, 0 AS source FROM {agenda_item} WHERE catalog_id NOT IN (SELECT catalog_id FROM big) UNION ALL SELECT catalog_id, item_order, title, 1 FROM p), n AS (SELECT *, catalog_id IN (SELECT catalog_id FROM big) AS e, row_number() OVER (PARTITION BY catalog_id, lower(title) ORDER BY source, item_order) AS k FROM u) SELECT catalog_id, item_order, title, source FROM n WHERE e OR source = 0 OR k = 1")
def u7_merge_agendas(t):
    portal = t.agenda_item.filter("catalog_id % 4 = 0 OR item_order < 2").select("catalog_id", "item_order", F.when(F.col("item_order") % 2 == 0, F.lower("title")).otherwise(F.concat("title", F.lit("!"))).alias("title"))
    return merging.merge_agendas(t.agenda_item, portal)


@query("SELECT catalog_id, CASE WHEN count(*) = count(*) FILTER (g) THEN 'delete' ELSE 'reset' END AS action FROM (SELECT d.catalog_id, e.source = 'nation_6' AND e.record_date >= DATE '1996-01-01' AS g FROM {document} d JOIN {event} e ON e.id = d.event_id) x GROUP BY 1 HAVING count(*) FILTER (g) > 0")
def u11_purge_city(t):
    document = t.document.join(t.event.select(F.col("id").alias("event_id")), "event_id", "left_semi")
    return merging.purge_city(t.event, document, "nation_6", "1996-01-01")[1]


@query("WITH r AS (SELECT doc_id, lang, row_number() OVER (ORDER BY (doc_id * 7919) % 10007 DESC, doc_id) AS rank FROM {documents}), k AS (SELECT rank, row_number() OVER (ORDER BY rank) AS nth FROM r WHERE lang = 'fr' AND rank <= 10000), n AS (SELECT max(rank) FILTER (nth = 60) AS needed, count(*) AS hits FROM k) SELECT CAST(coalesce(least(10000, 480 * pow(2, greatest(0, ceil(log2(needed / 480))))), 10000) AS INTEGER) AS k_used, hits FROM n")
def w5_expansion(t):
    scored = t.documents.select(F.col("doc_id").alias("id"), "lang", ((F.col("doc_id") * 7919) % 10007).alias("score"))
    return merging.expansion(scored, F.col("lang") == "fr", 60)


@query("WITH c AS (SELECT p_partkey AS catalog_id, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank, p_retailprice / 7 AS score FROM {part}), p AS (SELECT * FROM c WHERE catalog_id <> 0 ORDER BY rank LIMIT 20 OFFSET 10) SELECT p.catalog_id, p.rank, round(p.score, 6) AS score, k.brand FROM p JOIN {catalog} k ON k.id = p.catalog_id")
def g8_hydrate(t):
    from pyspark.sql import Window

    # only the page is numbered, after a distributed top-k; one row more, as the part with key 0 drops out
    top = t.part.orderBy(F.desc("p_retailprice"), "p_partkey").limit(10 + 20 + 1)
    c = top.select(F.col("p_partkey").alias("catalog_id"), F.row_number().over(Window.orderBy(F.desc("p_retailprice"), "p_partkey")).alias("rank"), (F.col("p_retailprice") / 7).alias("score"))
    return merging.hydrate(c, t.catalog.select(F.col("id").alias("catalog_id"), "brand"), 20, 10)


@query("WITH a AS (SELECT concat(event_type, '_', CAST(user_id % 5 AS VARCHAR)) AS metric, CAST(sum(CAST(round(value) AS BIGINT)) AS DOUBLE) AS v FROM {events} WHERE event_id % 2 = 0 GROUP BY 1), e AS (SELECT concat(event_type, '_', CAST(user_id % 6 AS VARCHAR)) AS metric, CAST(sum(CAST(round(value) AS BIGINT)) AS DOUBLE) AS v FROM {events} WHERE event_id % 2 = 1 GROUP BY 1) SELECT coalesce(a.metric, e.metric) AS metric, a.v AS actual, e.v AS expected, CASE WHEN a.v IS NULL THEN 'missing' WHEN e.v IS NULL THEN 'new' WHEN a.v > e.v * 1.25 THEN 'regression' ELSE 'ok' END AS status FROM a FULL JOIN e ON e.metric = a.metric")
def a20_against_baseline(t):
    def totals(rest, n, name):
        return t.events.filter(F.col("event_id") % 2 == rest).groupBy(F.concat("event_type", F.lit("_"), (F.col("user_id") % n).cast("string")).alias("metric")).agg(F.sum(F.round("value").cast("long")).cast("double").alias(name))

    return merging.against_baseline(totals(0, 5, "actual"), totals(1, 6, "expected"))


@query("SELECT id, CAST(length(coalesce(content, '')) AS BIGINT) AS chars, contains(coalesce(content, ''), '[PAGE ') AS has_page_markers FROM {catalog}")
def f18_content_projection(t):
    return merging.content_projection(t.catalog)


@query(
    "WITH d AS (SELECT id AS catalog_id FROM {catalog} WHERE content <> '' AND summary <> '' ORDER BY md5(concat('7:', CAST(id AS VARCHAR))), id LIMIT 20) "
    "SELECT format('S{:03d}', row_number() OVER (ORDER BY catalog_id)) AS sample_id, catalog_id, CASE WHEN substring(md5(concat('8:', CAST(catalog_id AS VARCHAR))), 1, 1) < '8' THEN 'A' ELSE 'B' END AS option_a_arm FROM d"
)
def w8_blinded_pairs(t):
    c = t.catalog.select(F.col("id").alias("catalog_id"), F.col("content").alias("text"))
    return merging.blinded_pairs(c, t.catalog.select(F.col("id").alias("catalog_id"), F.col("summary").alias("text")), 7)
