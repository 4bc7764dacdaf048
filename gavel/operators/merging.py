"""Merging sources of agenda rows, removing a city's graph, over-fetch diagnostics, hydration, baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_agendas(model: DataFrame, portal: DataFrame, enough: int = 3) -> DataFrame:
    """Rows (catalog_id, item_order, title) of each catalog: the portal's alone where it has enough, else the model's and then the portal's that no earlier row's title equals, case aside."""
    counted = portal.groupBy("catalog_id").agg((F.count("*") >= enough).alias("_enough"))
    rows = model.select("catalog_id", "item_order", "title", F.lit(0).alias("source")).union(portal.select("catalog_id", "item_order", "title", F.lit(1)))
    d = rows.join(counted, "catalog_id", "left").withColumn("_enough", F.coalesce("_enough", F.lit(False)))
    d = d.filter(~F.col("_enough") | (F.col("source") == 1))
    nth = F.row_number().over(Window.partitionBy("catalog_id", F.lower("title")).orderBy("source", "item_order"))
    return d.withColumn("_nth", F.when(F.col("_enough") | (F.col("source") == 0), 1).otherwise(nth)).filter("_nth = 1").select("catalog_id", "item_order", "title", "source")


def purge_city(event: DataFrame, document: DataFrame, city: str, since: str | None = None) -> tuple[DataFrame, DataFrame]:
    """What removing a city's events does: documents that survive, and (catalog_id, action) of touched catalogs: delete where every document goes, reset where others stay."""
    selected = event.filter(F.col("source") == city)
    selected = selected.filter(F.col("record_date") >= since) if since else selected
    d = document.join(selected.select(F.col("id").alias("event_id"), F.lit(True).alias("_gone")), "event_id", "left").withColumn("_gone", F.coalesce("_gone", F.lit(False)))
    catalogs = d.groupBy("catalog_id").agg(F.count("*").alias("all"), F.count_if("_gone").alias("gone")).filter("gone > 0")
    return d.filter(~F.col("_gone")).drop("_gone"), catalogs.select("catalog_id", F.when(F.col("all") == F.col("gone"), "delete").otherwise("reset").alias("action"))


def expansion(scored: DataFrame, keep, target: int, first: int = 200, most: int = 10_000) -> DataFrame:
    """One row: k_used, hits: how far a search that doubles k from max(first, 8 * target) to most must look until target kept rows are found."""
    best = Window.orderBy(F.desc("score"), "id")
    top = scored.orderBy(F.desc("score"), "id").limit(most).withColumn("rank", F.row_number().over(best))  # at most `most` rows
    kept = top.filter(keep).withColumn("nth", F.row_number().over(Window.orderBy("rank")))
    d = kept.agg(F.max(F.when(F.col("nth") == target, F.col("rank"))).alias("needed"), F.count("*").alias("hits"))
    start = max(first, 8 * target)
    steps = F.greatest(F.lit(0), F.ceil(F.log2(F.col("needed") / start)))
    return d.select(F.coalesce(F.least(F.lit(most), (start * F.pow(F.lit(2), steps))), F.lit(most)).cast("int").alias("k_used"), "hits")


def hydrate(candidates: DataFrame, details: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page of candidates (catalog_id, rank, score) with details, in candidates' order; id 0 and those without details drop out."""
    page = candidates.filter("catalog_id <> 0").orderBy("rank").offset(offset).limit(limit)
    return page.join(details, "catalog_id").withColumn("score", F.round("score", 6)).orderBy("rank")


def against_baseline(actual: DataFrame, expected: DataFrame, tolerance: float = 0.25) -> DataFrame:
    """metric, actual, expected, status: missing, new, regression (above expected by more than the tolerance) or ok."""
    d = actual.join(expected, "metric", "full")
    status = F.when(F.col("actual").isNull(), "missing").when(F.col("expected").isNull(), "new").when(F.col("actual") > F.col("expected") * (1 + tolerance), "regression").otherwise("ok")
    return d.select("metric", "actual", "expected", status.alias("status"))


def content_projection(catalog: DataFrame) -> DataFrame:
    """id, chars, has_page_markers of catalogs' content."""
    return catalog.select("id", F.length(F.coalesce("content", F.lit(""))).cast("long").alias("chars"), F.coalesce("content", F.lit("")).contains("[PAGE ").alias("has_page_markers"))


def blinded_pairs(control: DataFrame, treatment: DataFrame, seed: int, n: int = 20) -> DataFrame:
    """sample_id, catalog_id, option_a_arm: n catalogs that have text in both arms, drawn by a hash of the seed, numbered S001 on by catalog, with the arm that is shown first."""
    both = control.filter(F.coalesce("text", F.lit("")) != "").select("catalog_id").join(treatment.filter(F.coalesce("text", F.lit("")) != "").select("catalog_id"), "catalog_id").distinct()
    drawn_by = lambda s: F.md5(F.concat(F.lit(f"{s}:"), F.col("catalog_id").cast("string")).cast("binary"))
    drawn = both.orderBy(drawn_by(seed), "catalog_id").limit(n)
    d = drawn.withColumn("_n", F.row_number().over(Window.orderBy("catalog_id")))  # n rows
    return d.select(F.format_string("S%03d", "_n").alias("sample_id"), "catalog_id", F.when(F.substring(drawn_by(seed + 1), 1, 1) < "8", "A").otherwise("B").alias("option_a_arm"))
