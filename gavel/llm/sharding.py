"""Balanced shards from global prefix sums of byte sizes (operator 7, DataFrame functions only).

Rows are dealt into key ranges; each range's total is summed up with those before
it, so a row's place in the global order of bytes is its range's offset plus a
running sum within the range. The byte line is cut at equal targets: the shard of
a row is the one that holds the middle of its bytes, so shards are contiguous in
the order of keys and differ by about one row's size.

Defined results: a null text has no bytes and size 1; repeated rows are dealt
like others (a row number makes the order total; equal rows are
interchangeable); null keys come first; an empty table gives no rows; other
columns are ignored. grown_shard is null, as this law moves rows freely when
the number of shards changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut


def shards(df: DataFrame, n_shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, law, shard, slot, grown_shard."""
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sized = df.select(
        F.col(key).alias(key),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("_row"),
    )
    # the ranges come from a sample, so they are fixed by writing them down
    dealt = cut(sized.repartitionByRange(ranges, key, "text_crc32", "_row").withColumn("_range", F.spark_partition_id()))
    totals = dealt.groupBy("_range").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = totals.select(
        "_range",
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes_before"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
        F.sum("_bytes").over(every).alias("_all_bytes"),
    )
    within = Window.partitionBy("_range").orderBy(key, "text_crc32", "_row")
    placed = (
        dealt.withColumn("_upto", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_nth", F.row_number().over(within))
        .join(F.broadcast(totals), "_range")
        .select(
            key,
            "size",
            "text_crc32",
            # twice the middle of the row's bytes, against twice the total
            F.least(F.lit(n_shards - 1), F.floor((2 * (F.col("_bytes_before") + F.col("_upto")) - F.col("size")) * n_shards / (2 * F.col("_all_bytes")))).cast("int").alias("shard"),
            (F.col("_rows_before") + F.col("_nth") - 1).alias("_rank"),
        )
    )
    firsts = placed.groupBy("shard").agg(F.min("_rank").alias("_first"))  # n_shards rows
    return placed.join(F.broadcast(firsts), "shard").select(
        key, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_rank") - F.col("_first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
