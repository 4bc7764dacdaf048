"""Structured Streaming versions of staging promotion, phase histograms and dispatch pairing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gavel.operators import records
from gavel.operators.runs import BUCKETS


def promote_stream(stage: DataFrame, event: Callable[[], DataFrame], place: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Promote staged rows as they arrive. event() reads the current events; a replayed batch finds its rows there and promotes none twice."""

    def batch(rows: DataFrame, number: int) -> None:
        write(records.promote(rows, event(), place).filter("outcome = 'promoted'").drop("outcome"), number)

    return stage.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def phase_buckets(spans: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """window, phase, le, n: spans (ts, phase, duration_s) counted in the least bucket that holds them, for each stretch of time; works on streams and on tables."""
    le = F.coalesce(*(F.when(F.col("duration_s") <= b, F.lit(b)) for b in BUCKETS), F.lit(float("inf")))
    d = spans.withWatermark("ts", late) if spans.isStreaming else spans
    return d.groupBy(F.window("ts", width), "phase", le.alias("le")).agg(F.count("*").alias("n"))


def paired(dispatched: DataFrame, finished: DataFrame, timeout: str = "1 hour") -> DataFrame:
    """task_id, retry, dispatched_at, finished_at: dispatches with their end; without one once the timeout has passed. Works on streams and on tables."""
    d = dispatched.select("task_id", "retry", F.col("ts").alias("dispatched_at"))
    f = finished.select(F.col("task_id").alias("_task"), F.col("retry").alias("_retry"), F.col("ts").alias("finished_at"))
    if dispatched.isStreaming:
        d, f = d.withWatermark("dispatched_at", "10 minutes"), f.withWatermark("finished_at", "10 minutes")
    same = (F.col("task_id") == F.col("_task")) & (F.col("retry") == F.col("_retry"))
    soon = (F.col("finished_at") >= F.col("dispatched_at")) & (F.col("finished_at") <= F.col("dispatched_at") + F.expr(f"INTERVAL {timeout}"))
    return d.join(f, same & soon, "left_outer").drop("_task", "_retry")


def parquet_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def append_stream(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write what a stream settles as Parquet, once: a restart goes on from the checkpoint."""
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def reconciled_pairs(emitted: DataFrame, dispatched: DataFrame, finished: DataFrame, timeout: str = "1 hour") -> DataFrame:
    """What the stream emitted, and the dispatches that it still holds open, paired from the tables; settled tells which. A late or replayed row is in neither twice."""
    open_rows = dispatched.join(emitted.select("task_id", "retry"), ["task_id", "retry"], "left_anti")
    return emitted.withColumn("settled", F.lit(True)).unionByName(paired(open_rows, finished, timeout).withColumn("settled", F.lit(False)))


def reconciled_buckets(emitted: DataFrame, spans: DataFrame, width: str = "5 minutes") -> DataFrame:
    """window, phase, le, n of the windows that the stream closed, and from the table of those that are still open; late is how many more rows the table has than the stream counted."""
    whole = phase_buckets(spans, width=width)
    d = whole.withColumnRenamed("n", "_n").join(emitted, ["window", "phase", "le"], "full")
    last = emitted.agg(F.max("window.end").alias("_last"))  # one row
    d = d.crossJoin(F.broadcast(last))
    closed = F.coalesce(F.col("window.end") <= F.col("_last"), F.lit(False))
    return d.select("window", "phase", "le", F.when(closed, F.coalesce("n", F.lit(0))).otherwise(F.col("_n")).alias("n"), F.when(closed, F.coalesce("_n", F.lit(0)) - F.coalesce("n", F.lit(0))).otherwise(0).alias("late"))
