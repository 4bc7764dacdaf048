"""Queries that run as streams over files written slice by slice, with the twins of their tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel.plans.bridge import Tables, twin
from gavel.plans.tables import new_folder
from gavel.streaming import jobs

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
SLICES = 4


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = twin(sql)
        return f

    return add


def delivered(rows: DataFrame, part: Column, again: Column, path: str) -> DataFrame:
    """rows as a stream of files, one for each slice of days in order; the last one brings rows of the first again, late. One file at a time is read."""
    for k in range(SLICES):
        slice_rows = rows.filter(part == k) if k < SLICES - 1 else rows.filter((part == k) | ((part == 0) & again))
        slice_rows.coalesce(1).write.mode("append").parquet(path)
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def part_of(ts: str) -> Column:
    return F.least(F.floor((F.dayofmonth(ts) - 1) / 8), F.lit(SLICES - 1))


@query("SELECT strftime(to_timestamp(floor(epoch(ts) / 300) * 300) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS start, phase, CASE WHEN duration_s <= 0.1 THEN 0.1 WHEN duration_s <= 0.5 THEN 0.5 WHEN duration_s <= 1 THEN 1 WHEN duration_s <= 5 THEN 5 WHEN duration_s <= 10 THEN 10 WHEN duration_s <= 30 THEN 30 WHEN duration_s <= 60 THEN 60 WHEN duration_s <= 120 THEN 120 ELSE -1 END AS le, count(*) AS n, 0 AS late FROM {span} GROUP BY ALL")
def m2_streamed_buckets(t):
    path = new_folder(t._spark, "spans")
    rows = t.span.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "phase", "duration_s")
    stream = delivered(rows, part_of("ts"), F.col("event_id") % 50 == 0, f"{path}/in")
    jobs.append_stream(jobs.phase_buckets(stream), f"{path}/out", f"{path}/checkpoint").awaitTermination()
    d = jobs.reconciled_buckets(t._spark.read.parquet(f"{path}/out"), rows)
    return d.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "phase", F.when(F.col("le") == float("inf"), -1.0).otherwise(F.col("le")).alias("le"), "n", F.col("late").cast("int").alias("late"))


@query("SELECT event_id AS task_id, event_id % 5 NOT IN (0, 1, 2) AS finished, CASE WHEN event_id % 5 NOT IN (0, 1, 2) THEN 5 END AS minutes FROM {events}")
def m3_streamed_pairs(t):
    """Every dispatch once: with its end, or without one because the timeout has passed or the stream still waits."""
    path = new_folder(t._spark, "tasks")
    e = t.events.select(F.col("event_id").alias("task_id"), F.lit(0).alias("retry"), F.col("ts").cast("timestamp").alias("ts"))
    k = F.col("task_id") % 5
    moved = F.when(k == 1, F.col("ts") - F.expr("INTERVAL 1 MINUTE")).when(k == 2, F.col("ts") + F.expr("INTERVAL 90 MINUTES")).otherwise(F.col("ts") + F.expr("INTERVAL 5 MINUTES"))
    ends = e.select("task_id", F.when(k == 0, 1).otherwise(0).alias("retry"), moved.alias("ts"), "ts").toDF("task_id", "retry", "ts", "at")
    begun = delivered(e, part_of("ts"), F.col("task_id") % 50 == 3, f"{path}/begun")
    over = delivered(ends, part_of("at"), F.col("task_id") % 50 == 3, f"{path}/over")
    jobs.append_stream(jobs.paired(begun, over), f"{path}/out", f"{path}/checkpoint").awaitTermination()
    d = jobs.reconciled_pairs(t._spark.read.parquet(f"{path}/out"), e, ends)
    return d.select("task_id", F.col("finished_at").isNotNull().alias("finished"), ((F.unix_timestamp("finished_at") - F.unix_timestamp("dispatched_at")) / 60).cast("int").alias("minutes"))
