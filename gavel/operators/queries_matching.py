"""Queries of fuzzy matches, semantic rows, reranking, gates, snapshots and the function surface, with DuckDB twins where SQL has the measure."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from gavel.functions import text as X
from gavel.operators import matching, records
from gavel.operators.agenda_text import chunks
from gavel.operators.queries_agenda import chunked
from gavel.operators.queries_records import FIRST, QUALITY
from gavel.operators.queries_search import KIND, QVEC, STAR, star
from gavel.plans.bridge import Tables, from_sql, twin

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = twin(sql)
        return f

    return add


VARIED = "(SELECT catalog_id, id AS item, page_number, CASE item_order % 3 WHEN 0 THEN title WHEN 1 THEN concat(title, ' x') ELSE concat('Zebra ', id % 97) END AS title FROM {agenda_item} a)"


def contents(t):
    return t.catalog.select(F.col("id").alias("catalog_id"), "summary", "content")


def references(t):
    return t.agenda_item.select("catalog_id", F.col("id").alias("item"), "title")


@query()
def j11_page_titles(t):
    m = matching.best_titles(from_sql(t, "SELECT * FROM " + VARIED + " v"), references(t), "catalog_id", matching.PAGE_TITLE)
    return m.join(t.agenda_item.select(F.col("id").alias("reference"), "page_number"), "reference").select("item", "page_number", "ratio")


@query()
def j14_official_titles(t):
    official = t.agenda_item.select("catalog_id", F.col("id").alias("item"), F.lower(F.concat(F.lit("the "), F.col("title"))).alias("title"))
    local = t.agenda_item.select("catalog_id", F.col("id").alias("item"), F.lower("title").alias("title"))
    return matching.best_titles(official, local, "catalog_id", matching.OFFICIAL_TITLE, above=True)


@query()
def x12_near_titles(t):
    return matching.near_titles(t.agenda_item)


TEXTS = "(SELECT catalog_id, id AS item_id, substring(concat(COLLAPSE(coalesce(title, '')), '.'), 1, 4000) AS text FROM {agenda_item} i WHERE length(concat(COLLAPSE(coalesce(title, '')), '.')) >= 20)"


@query(
    "WITH s AS (SELECT id, catalog_id, substring(COLLAPSE(coalesce(summary, '')), 1, 4000) AS short FROM " + STAR + " x), has AS (SELECT DISTINCT catalog_id FROM {agenda_item}), i AS " + TEXTS + ", r AS ("
    "SELECT 'meeting' AS result_type, id AS db_id, 'summary' AS source_type, short AS text FROM s WHERE length(short) >= 20 UNION ALL SELECT 'meeting', s.id, 'agenda_item', i.text FROM s JOIN i ON i.catalog_id = s.catalog_id WHERE length(short) < 20 "
    "UNION ALL SELECT 'agenda_item', i.item_id, 'agenda_item_result', i.text FROM i WHERE catalog_id IN (SELECT catalog_id FROM s)) SELECT result_type, db_id, source_type, count(*) AS n, sum(length(text)) AS chars FROM r GROUP BY ALL"
)
def g6_semantic_rows(t):
    # every text here has items or no content, so no chunks arise; x4_chunks has those
    rows = matching.semantic_rows(star(t), contents(t), t.agenda_item, lambda c: chunks(c), F.length)
    return rows.groupBy("result_type", "db_id", "source_type").agg(F.count("*").alias("n"), F.sum("text").alias("chars"))


#: Items of three catalogs in four, so that some catalogs have neither summary nor items.
SOME_TEXTS = TEXTS.replace("WHERE length", "WHERE catalog_id % 4 <> 0 AND length")


@query(
    "WITH RECURSIVE s AS (SELECT id, catalog_id, content, substring(COLLAPSE(coalesce(summary, '')), 1, 4000) AS short FROM " + STAR + " x), i AS " + SOME_TEXTS + ", has AS (SELECT DISTINCT catalog_id FROM {agenda_item} a WHERE catalog_id % 4 <> 0), "
    "bare AS (SELECT DISTINCT catalog_id, content FROM s WHERE length(short) < 20 AND catalog_id NOT IN (SELECT catalog_id FROM has)), " + chunked("bare", "catalog_id", "content") + ", r AS ("
    "SELECT 'meeting' AS result_type, id AS db_id, 'summary' AS source_type, short AS text FROM s WHERE length(short) >= 20 UNION ALL SELECT 'meeting', s.id, 'agenda_item', i.text FROM s JOIN i ON i.catalog_id = s.catalog_id WHERE length(short) < 20 "
    "UNION ALL SELECT 'meeting', s.id, 'content_chunk', chunk FROM s JOIN chunk c ON c.catalog_id = s.catalog_id WHERE length(short) < 20 AND chunk_no >= 0 AND length(chunk) >= 20 "
    "UNION ALL SELECT 'agenda_item', i.item_id, 'agenda_item_result', i.text FROM i WHERE catalog_id IN (SELECT catalog_id FROM s)) SELECT result_type, db_id, source_type, SHA(text) AS text_sha256 FROM r"
)
def g6_semantic_texts(t):
    items = t.agenda_item.filter("catalog_id % 4 <> 0")
    return matching.semantic_rows(star(t), contents(t), items, lambda c: chunks(c), lambda text: F.sha2(text, 256)).withColumnRenamed("text", "text_sha256")


Q = str(QVEC) + "::DOUBLE[]"


@query(
    "WITH h AS (SELECT catalog_id, min((id * 31) % 9973) AS rank FROM {document} GROUP BY 1), f AS (SELECT * FROM h ORDER BY rank, catalog_id LIMIT 200), s AS (SELECT f.catalog_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), " + Q + ") / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product(" + Q + ", " + Q + "))), 6) AS score FROM f JOIN {embeddings} e ON e.vec_id + 1 = f.catalog_id WHERE e.label IS NOT NULL) SELECT catalog_id, score, row_number() OVER (ORDER BY score DESC, catalog_id) AS position FROM s"
)
def g7_hybrid_rerank(t):
    hits = t.document.select("catalog_id", ((F.col("id") * 31) % 9973).alias("rank"))
    stored = t.embeddings.select((F.col("vec_id") + 1).alias("catalog_id"), F.col("embedding").alias("vector"), F.col("label").isNotNull().alias("fresh"))
    return matching.rerank(hits, stored, QVEC)


DAYS = "(SELECT CAST(CAST(ts AS DATE) AS VARCHAR(10)) AS day, true AS baseline_valid, CAST(count(*) AS DOUBLE) AS requests, CAST(sum(CASE WHEN value > 99.9 THEN 1 ELSE 0 END) AS DOUBLE) AS timeouts, CAST(sum(CASE WHEN value < 1 THEN 1 ELSE 0 END) AS DOUBLE) AS retries, sum(CASE WHEN user_id < 0 THEN 1 ELSE 0 END) AS gating_failures, round(avg(value), 6) AS queue_p95, CASE WHEN CAST(sum(user_id) AS BIGINT) % 3 = 0 THEN NULL ELSE CAST(max(user_id) AS DOUBLE) END AS segment_p95, round(max(value), 6) AS search_p95 FROM {events} e GROUP BY CAST(CAST(ts AS DATE) AS VARCHAR(10)))"


def _drift(c: str) -> str:
    return f"coalesce(len({c}) >= 4 AND ({c}[1] + {c}[2]) / 2 <> 0 AND (({c}[-1] + {c}[-2]) / 2 - ({c}[1] + {c}[2]) / 2) / nullif(({c}[1] + {c}[2]) / 2, 0) > 0.2, false)"


@query(
    "WITH d AS (SELECT * FROM " + DAYS + " x ORDER BY day DESC LIMIT 7), o AS (SELECT count(*) FILTER (requests IS NOT NULL AND timeouts IS NOT NULL AND retries IS NOT NULL) AS measured, max(CASE WHEN requests > 0 THEN timeouts / requests END) AS rate, count(*) FILTER (timeouts > 0 AND retries > 0 AND retries / greatest(1.0, timeouts) >= 3) AS storms, count(*) FILTER (gating_failures > 0) AS failed, list(queue_p95 ORDER BY day) FILTER (queue_p95 IS NOT NULL) AS q, list(segment_p95 ORDER BY day) FILTER (segment_p95 IS NOT NULL) AS g, max(search_p95) AS search FROM d) "
    "SELECT 'provider_timeout_rate' AS gate, CASE WHEN rate IS NULL OR measured <> 7 THEN 'INCONCLUSIVE' WHEN rate < 0.01 THEN 'PASS' ELSE 'FAIL' END AS status FROM o UNION ALL SELECT 'timeout_storms', CASE WHEN storms = 0 THEN 'PASS' ELSE 'FAIL' END FROM o UNION ALL SELECT 'no_failed_days', CASE WHEN failed = 0 THEN 'PASS' ELSE 'FAIL' END FROM o UNION ALL SELECT 'queue_stable', CASE WHEN " + _drift("q") + " THEN 'FAIL' ELSE 'PASS' END FROM o UNION ALL SELECT 'segment_stable', CASE WHEN " + _drift("g") + " THEN 'FAIL' ELSE 'PASS' END FROM o UNION ALL SELECT 'search_regression', CASE WHEN (search - 80.0) / 80.0 <= 0.15 THEN 'PASS' ELSE 'FAIL' END FROM o"
)
def a19_soak_gates(t):
    return matching.soak_gates(from_sql(t, "SELECT * FROM " + DAYS + " d"), 7, 80.0)


FLAGS = "(SELECT c.id, coalesce(" + KIND.format("category") + ", 'unknown') AS kind, coalesce(content, '') <> '' AS has_content, coalesce(summary, '') <> '' AS has_summary, coalesce(n, 0) AS items FROM {catalog} c LEFT JOIN " + FIRST + " f ON f.catalog_id = c.id LEFT JOIN (SELECT catalog_id, count(*) AS n FROM {agenda_item} GROUP BY 1) i ON i.catalog_id = c.id)"


@query(
    "WITH f AS (SELECT f.*, coalesce(char_count >= 80 AND distinct_token_count >= 8 AND alpha_ratio >= 0.35 AND boilerplate_line_ratio <= 0.85, false) AS ok FROM " + FLAGS + " f LEFT JOIN " + QUALITY + " q ON q.id = f.id), n AS (SELECT count(*) AS catalogs, count(*) FILTER (has_content) AS with_content, count(*) FILTER (has_summary) AS with_summary, count(*) FILTER (has_content AND NOT has_summary) AS missing, count(*) FILTER (has_content AND NOT has_summary AND kind = 'agenda' AND items > 0) AS agenda_with_items, count(*) FILTER (has_content AND NOT has_summary AND kind = 'agenda' AND items = 0) AS agenda_without_items, count(*) FILTER (has_content AND NOT has_summary AND kind <> 'agenda' AND ok) AS other_summarizable, count(*) FILTER (has_content AND NOT has_summary AND kind <> 'agenda' AND NOT ok) AS other_blocked FROM f) "
    "SELECT *, CASE WHEN agenda_without_items > 0 AND agenda_without_items >= 0.8 * missing THEN 'agenda_segmentation_blocked' WHEN other_summarizable > 0 THEN 'non_agenda_unscheduled' WHEN other_blocked > 0 THEN 'quality_gate' WHEN agenda_with_items > 0 THEN 'agenda_unscheduled' ELSE 'no_dominant_backlog' END AS cause FROM n"
)
def a12_hydration_snapshot(t):
    kind = records.first_document_kind(t.document).select(F.col("catalog_id").alias("id"), "kind")
    items = t.agenda_item.groupBy(F.col("catalog_id").alias("id")).agg(F.count("*").alias("n"))
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    flags = t.catalog.join(kind, "id", "left").join(items, "id", "left").select(F.coalesce("kind", F.lit("unknown")).alias("kind"), filled("content").alias("has_content"), filled("summary").alias("has_summary"), F.coalesce("n", F.lit(0)).alias("items"), F.coalesce(X.is_summarizable(X.source_quality(F.col("content"))), F.lit(False)).alias("summarizable"))
    return matching.hydration_snapshot(flags)


@query("SELECT id, " + KIND.format("category") + " AS kind FROM {document}")
def p1_sql_functions(t):
    matching.register_sql_functions(t._spark)
    return t._spark.sql("SELECT id, doc_kind(category) AS kind FROM {d}", d=t.document)


@query("SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS score FROM {documents}")
def p2_model_column(t):
    def model(batches):
        import pyarrow.compute as pc

        for b in batches:
            yield pc.cast(pc.fill_null(pc.binary_length(pc.cast(b.column(0), "binary")), 0), "int64")

    return matching.with_model_column(t.documents.select("doc_id", "text"), ["text"], model, "score", T.LongType()).select("doc_id", "score")


RAW = "regexp_replace(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), '(?m)^[ \\t]+|[ \\t]+$', '', 'g')"
TRIMMED = "list_filter(list_transform({0}, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"


@query(
    "WITH r AS (SELECT doc_id, " + RAW + " AS raw FROM {documents}), b AS (SELECT doc_id, raw, " + TRIMMED.format("regexp_split_to_array(raw, '\\n\\s*\\n')") + " AS blank, " + TRIMMED.format("regexp_split_to_array(regexp_replace(concat(chr(10), raw), '" + matching.PARAGRAPH_START + "', concat(chr(10), chr(10), '\\1'), 'g'), '\\n\\n+')") + " AS marked FROM r), p AS (SELECT doc_id, CASE WHEN len(blank) >= 3 THEN blank ELSE marked END AS p FROM b) SELECT doc_id, generate_subscripts(p, 1) - 1 AS paragraph_no, unnest(p) AS paragraph FROM p"
)
def p3_paragraphs(t):
    return matching.paragraphs(t.documents, "doc_id", "text")
