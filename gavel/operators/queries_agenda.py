"""Queries of rows from pages and action texts with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from gavel.operators import agenda_text, runs
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


def _lines_sql() -> str:
    t = "coalesce(html, '')"
    for tag in ("script", "style", "noscript"):
        t = f"regexp_replace({t}, '(?is)<{tag}\\b.*?</{tag}\\s*>', ' ', 'g')"
    t = f"regexp_replace({t}, '(?i)<(?:br|p|li|td|tr|div|h[1-6])\\b[^>]*>', chr(10), 'g')"
    t = f"regexp_replace({t}, '(?s)<!--.*?-->|<[^>]*>', ' ', 'g')"
    for entity, text in agenda_text._ENTITIES:
        t = f"replace({t}, '{entity}', '{text.replace(chr(39), chr(39) * 2)}')"
    return f"list_filter(list_transform(regexp_split_to_array({t}, '[\\n\\r]'), lambda x: trim(regexp_replace(x, '[ \\t\\f\\x0B]+', ' ', 'g'))), lambda x: x <> '')"


@query("SELECT page_id, len(l) AS lines, md5(array_to_string(l, chr(10))) AS digest FROM (SELECT page_id, " + _lines_sql() + " AS l FROM {pages}) p")
def s9_html_lines(t):
    d = t.pages.select("page_id", agenda_text.html_lines(F.col("html")).alias("l"))
    return d.select("page_id", F.size("l").cast("long").alias("lines"), F.md5(F.array_join("l", "\n").cast("binary")).alias("digest"))


ROWS = "(SELECT catalog_id, item_order, CASE WHEN item_order % 3 = 0 THEN 'no number' WHEN item_order % 3 = 1 THEN concat(CAST(item_order AS VARCHAR), '. ', substring(title, 1, 30)) ELSE concat('Item ', CAST(item_order AS VARCHAR), ') ', 'Second reading ', CAST(item_order % 4 AS VARCHAR)) END AS line FROM {agenda_item})"
PATTERN = agenda_text.ROW_PATTERN


@query("WITH m AS (SELECT catalog_id, item_order AS n, regexp_extract(line, '" + PATTERN + "', 1) AS marker, trim(regexp_extract(line, '" + PATTERN + "', 2)) AS title FROM " + ROWS + " r), u AS (SELECT *, row_number() OVER (PARTITION BY catalog_id, lower(title) ORDER BY n) AS k FROM m WHERE marker <> '') SELECT catalog_id, item_order, marker, title FROM (SELECT *, row_number() OVER (PARTITION BY catalog_id ORDER BY n) AS item_order FROM u WHERE k = 1) o WHERE item_order <= 40")
def x15_numbered_rows(t):
    n = F.col("item_order")
    line = F.when(n % 3 == 0, "no number").when(n % 3 == 1, F.concat(n.cast("string"), F.lit(". "), F.substring("title", 1, 30))).otherwise(F.concat(F.lit("Item "), n.cast("string"), F.lit(") Second reading "), (n % 4).cast("string")))
    return agenda_text.numbered_rows(t.agenda_item.select("catalog_id", n.alias("line_no"), line.alias("line")), "catalog_id")


@query("SELECT o_orderkey AS id, v.vote, CASE v.k WHEN 1 THEN concat('Clerk', CAST(o_custkey AS VARCHAR)) WHEN 2 THEN 'Wei' WHEN 3 THEN 'Droste' ELSE 'Kim' END AS voter FROM {orders}, (SELECT unnest(['ayes', 'ayes', 'noes', 'absent']) AS vote, unnest([1, 2, 3, 4]) AS k) v WHERE NOT (v.k = 3 AND o_orderkey % 2 = 0)")
def x26_roll_calls(t):
    noes = F.when(F.col("o_orderkey") % 2 == 0, "None").otherwise("Droste")
    text = F.concat(F.lit("Motion carried. Ayes: Clerk"), F.col("o_custkey").cast("string"), F.lit(", and Wei. Noes : "), noes, F.lit(". Absent: Kim and 3."))
    return agenda_text.roll_calls(t.orders.select(F.col("o_orderkey").alias("id"), text.alias("text")), "id", "text")


def chunked(rows: str, key: str, text: str, whole: bool = False) -> str:
    """SQL of the tables rest_of and chunk (key, chunk_no, chunk): a collapsed text's longest beginning of at most 4,000 characters that ends with a word, again and again; if not whole, of 12,000 characters and five times at most."""
    first, fewer = ("", "") if whole else (", 1, 12000", " AND chunk_no < 4")
    within = "substring(rest, 1, 4001)"
    size = f"CASE WHEN length(rest) <= 4000 THEN length(rest) WHEN contains({within}, ' ') THEN 4001 - position(' ' IN reverse({within})) WHEN contains(rest, ' ') THEN position(' ' IN rest) - 1 ELSE length(rest) END"
    return (
        f"rest_of AS (SELECT {key}, rtrim({'substring(' * bool(first)}COLLAPSE(coalesce({text}, '')){first}{')' * bool(first)}) AS rest FROM {rows}), "
        f"chunk AS (SELECT {key}, -1 AS chunk_no, '' AS chunk, rest FROM rest_of UNION ALL SELECT {key}, chunk_no + 1, substring(rest, 1, k), substring(rest, k + 2) FROM (SELECT *, {size} AS k FROM chunk WHERE rest <> ''{fewer}) x)"
    )


#: Every document's text, some several times over, some with a word longer than a piece.
LONG = "(SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN concat(text, ' ', text, ' ', text, ' ', text, ' ', text, ' ', text) WHEN 1 THEN concat('a ', repeat('x', 4500), ' ', text) WHEN 2 THEN replace(text, ' ', '  ') ELSE text END AS text FROM {documents} d)"


@query("WITH RECURSIVE " + chunked(LONG + " l", "doc_id", "text", whole=True) + " SELECT doc_id, chunk_no, chunk FROM chunk WHERE chunk_no >= 0")
def x4_long_chunks(t):
    # where a text is null the SQL's concat leaves it out
    docs = from_sql(t, "SELECT * FROM " + LONG.replace("{documents}", "(SELECT doc_id, coalesce(text, '') AS text FROM {documents})") + " l")
    return docs.select("doc_id", F.posexplode(agenda_text.chunks(F.col("text"), scan=None, most=None)).alias("chunk_no", "chunk"))


@query("WITH RECURSIVE " + chunked("{documents}", "doc_id", "text", whole=True) + " SELECT doc_id, chunk_no, chunk FROM chunk WHERE chunk_no >= 0")
def x4_chunks(t):
    return t.documents.select("doc_id", F.posexplode(agenda_text.chunks(F.col("text"), scan=None, most=None)).alias("chunk_no", "chunk"))


@query("SELECT round(sum(CASE WHEN event_type = 'click' AND user_id = 5 THEN round(value, 2) ELSE 0 END), 6) AS total FROM {events}")
def a17_sum_metric(t):
    lines = t.events.select(F.concat(F.col("event_type"), F.lit('{user="'), F.col("user_id").cast("string"), F.lit('"} '), F.format_string("%.2f", F.round("value", 2))).alias("value"))
    return agenda_text.sum_metric(runs.metric_lines(lines), "click", {"user": "5"}).select(F.round("total", 6).alias("total"))
