"""Rows from pages and action texts: HTML lines, numbered rows, roll calls, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gavel.functions.text import collapse

#: Rows of a page at most, the operator's own limit.
MOST_ROWS = 40
#: Fixed value: a line that begins with an item's number.
ROW_PATTERN = r"(?i)^(?:agenda\s*)?(?:item|section)?\s*(\d{1,2}(?:\.\d+)*|[A-Z]|[IVXLCM]+)[\)\.\-:]\s+(.{6,220})$"
_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def html_lines(html: Column) -> Column:
    """The lines of text of a page: scripts and styles dropped, a break before blocks, entities decoded, white space collapsed, no blanks."""
    t = F.coalesce(html, F.lit(""))
    for tag in ("script", "style", "noscript"):
        t = F.regexp_replace(t, rf"(?is)<{tag}\b.*?</{tag}\s*>", " ")
    t = F.regexp_replace(t, r"(?i)<(?:br|p|li|td|tr|div|h[1-6])\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->|<[^>]*>", " ")
    for entity, text in _ENTITIES:
        t = F.replace(t, F.lit(entity), F.lit(text))
    return F.filter(F.transform(F.split(t, r"[\n\r]"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\f\x0B]+", " "))), lambda x: x != "")


def numbered_rows(lines: DataFrame, key: str = "page_id") -> DataFrame:
    """key, item_order, marker, title of lines (key, line_no, line) that begin with an item's number, the first of equal titles, MOST_ROWS for each key."""
    d = lines.select(key, "line_no", F.regexp_extract("line", ROW_PATTERN, 1).alias("marker"), F.trim(F.regexp_extract("line", ROW_PATTERN, 2)).alias("title")).filter("marker <> ''")
    d = d.withColumn("_n", F.row_number().over(Window.partitionBy(key, F.lower("title")).orderBy("line_no"))).filter("_n = 1")
    d = d.withColumn("item_order", F.row_number().over(Window.partitionBy(key).orderBy("line_no")))
    return d.filter(F.col("item_order") <= MOST_ROWS).select(key, "item_order", "marker", "title")


def roll_calls(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, vote (ayes, noes, absent or abstain), voter: each name that an action text lists after a marker, up to the next."""
    t = F.coalesce(F.col(text), F.lit(""))
    for name, pattern in (("ayes", r"(?i)Ayes?\s*:"), ("noes", r"(?i)Noes?\s*:"), ("absent", r"(?i)Absent\s*:"), ("abstain", r"(?i)Abstain\s*:")):
        t = F.regexp_replace(t, pattern, f"\x1e{name}\x1f")
    d = rows.select(key, F.explode(F.filter(F.split(t, "\x1e"), lambda x: x.contains("\x1f"))).alias("_part"))
    d = d.select(key, F.split_part("_part", F.lit("\x1f"), F.lit(1)).alias("vote"), F.regexp_replace(F.trim(F.split_part("_part", F.lit("\x1f"), F.lit(2))), r"\.\s*$", "").alias("_names"))
    d = d.select(key, "vote", F.explode(F.split("_names", r",\s*|\s+and\s+")).alias("_name"))
    d = d.select(key, "vote", F.trim(F.regexp_replace(F.trim("_name"), r"(?i)^and\s+", "")).alias("voter"))
    return d.filter(~F.lower("voter").isin("none", "") & ~F.col("voter").rlike(r"^\d+$"))


def roll_call_result(text: Column) -> Column:
    """The first word that tells an action's result."""
    found = F.lower(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?i)(carried|failed|was approved|was denied|adopted)", 1))
    return F.when(found != "", found)


def chunks(content: Column, most_chars: int = 4000, scan: int | None = 3, most: int | None = 5) -> Column:
    """Words packed into pieces of at most most_chars characters; a longer word is a piece of its own. Of the whole text, or of its first scan * most_chars; all pieces, or most at most."""
    text = collapse(F.coalesce(content, F.lit("")))
    text = F.rtrim(F.substring(text, 1, most_chars * scan)) if scan else text
    piece = rf"(?s)[^ ].{{0,{most_chars - 1}}}(?= |\z)|[^ ]+"
    found = F.regexp_extract_all(text, F.lit(piece), F.lit(0))
    return F.slice(found, 1, most) if most else found


def context_windows(titles: DataFrame, contents: DataFrame, key: str, before: int = 500, after: int = 1000) -> DataFrame:
    """id, window: of each title (key, id, title) whose key has a content (key, content) text.context_window, with the content in lower case once for all its titles.

    A content is followed by its titles in one task, so it is not put in a row with each of them.
    """
    kind = T.StructType([titles.schema["id"], T.StructField("window", T.StringType())])
    columns = [key, "side", "id", "size", "low", "content"]
    ours = titles.select(key, F.lit(1).alias("side"), "id", F.length("title").alias("size"), F.lower("title").alias("low"), F.lit(None).cast("string").alias("content"))
    theirs = contents.select(F.col(key).cast(titles.schema[key].dataType).alias(key), F.lit(0).alias("side"), F.lit(None).cast(titles.schema["id"].dataType).alias("id"), F.lit(0).alias("size"), F.lower("content").alias("low"), "content")

    def run(batches):
        import pyarrow as pa

        at, texts = None, []
        for batch in batches:
            ids, windows = [], []
            for k, side, i, size, low, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if side == 0:
                    texts = [*(texts if k == at else []), (low, content)]
                    at = k
                elif k == at and k is not None:
                    for low_content, whole in texts:
                        place = low_content.find(low) if size and whole is not None else -1
                        start = max(0, place - before)
                        ids.append(i)
                        windows.append(whole[start : max(start, place + size + after)] if place >= 0 else None)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(2).type), pa.array(windows, pa.string())], names=["id", "window"])

    return ours.unionByName(theirs).select(*columns).repartition(key).sortWithinPartitions(key, "side").mapInArrow(run, kind)


def sum_metric(metrics: DataFrame, name: str, labels: dict[str, str] | None = None) -> DataFrame:
    """One row, total: the sum of a metric's samples (name, labels, value) whose labels have the given values."""
    d = metrics.filter(F.col("name") == name)
    for k, v in (labels or {}).items():
        d = d.filter(F.col("labels")[k] == v)
    return d.agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("total"))
