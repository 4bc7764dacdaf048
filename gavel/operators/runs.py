"""Reports over processing runs: spans, arms, metrics, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavel.plans.tables import checkpointed

BUCKETS = (0.1, 0.5, 1.0, 5.0, 10.0, 30.0, 60.0, 120.0)


def at_ranks(rows: DataFrame, group: str, value: str, ranks: dict[str, Column]) -> DataFrame:
    """group and, for each name of ranks, the value at a rank (from 1; a column of n, the group's number of values): exact, nulls left out.

    Values are counted, and the counts dealt into ranges of (group, value); a range's place in its group is the sum of those before it, so no group is sorted in one task.
    """
    spark = rows.sparkSession
    counts = rows.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("_k"))
    # the ranges come from a sample, so they are fixed by writing them down
    dealt = checkpointed(counts.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), group, value).withColumn("_range", F.spark_partition_id()))
    parts = dealt.groupBy(group, "_range").agg(F.sum("_k").alias("_in"))  # as many rows as ranges and groups together, at most
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(group, "_range", F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_before"), F.sum("_in").over(Window.partitionBy(group)).alias("n"))
    within = Window.partitionBy(group, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    upto = dealt.join(parts, [group, "_range"]).withColumn("_upto", F.col("_before") + F.sum("_k").over(within))
    picked = [F.max(F.when((F.col("_upto") - F.col("_k") < rank) & (rank <= F.col("_upto")), F.col(value))).alias(name) for name, rank in ranks.items()]
    return upto.groupBy(group).agg(*picked)


def arm_aggregate(rows: DataFrame) -> DataFrame:
    """For each arm: rows, rates, nearest-rank 95th percentile and median of positive durations, and tokens."""
    n = F.col("n")
    p95 = at_ranks(rows, "arm", "duration_ms", {"p95_ms": F.ceil(n * 0.95)})
    middle = at_ranks(rows.filter("duration_ms > 0"), "arm", "duration_ms", {"_low": F.floor((n + 1) / 2), "_high": F.ceil((n + 1) / 2)})
    sums = rows.groupBy("arm").agg(
        F.count("*").alias("n"),
        F.round(F.avg("section_compliance_pass"), 6).alias("compliance_rate"),
        F.round(F.avg("fallback_used"), 6).alias("fallback_rate"),
        F.sum("total_tokens").alias("total_tokens"),
    )
    d = sums.join(p95, "arm", "left").join(middle, "arm", "left")
    return d.select("arm", "n", "compliance_rate", "fallback_rate", "p95_ms", ((F.col("_low") + F.col("_high")) / 2).alias("median_ms"), "total_tokens")


def arm_gates(arms: DataFrame, control: str = "A", treatment: str = "B", compliance_pp: float = 5.0, fallback_pp: float = 5.0, p95_percent: float = 20.0) -> DataFrame:
    """One row: differences of two arms in percentage points and percent, and whether each is within its gate."""
    a = arms.filter(F.col("arm") == control).select(*(F.col(c).alias(f"a_{c}") for c in arms.columns))
    b = arms.filter(F.col("arm") == treatment).select(*(F.col(c).alias(f"b_{c}") for c in arms.columns))
    d = a.crossJoin(b)  # one row each
    d = d.select(
        F.round(100 * (F.col("b_compliance_rate") - F.col("a_compliance_rate")), 4).alias("compliance_delta_pp"),
        F.round(100 * (F.col("b_fallback_rate") - F.col("a_fallback_rate")), 4).alias("fallback_delta_pp"),
        F.round(F.try_divide(100 * (F.col("b_p95_ms") - F.col("a_p95_ms")), F.col("a_p95_ms")), 4).alias("p95_delta_percent"),
    )
    return d.withColumns({"compliance_ok": F.col("compliance_delta_pp") >= -compliance_pp, "fallback_ok": F.col("fallback_delta_pp") <= fallback_pp, "p95_ok": F.col("p95_delta_percent") <= p95_percent})


def bottlenecks(spans: DataFrame, top: int = 3) -> DataFrame:
    """phase, total_s, spans, share of all, rank: where time went."""
    totals = spans.groupBy("phase").agg(F.sum(F.round(F.col("duration_s") * 1000).cast("long")).alias("ms"), F.count("*").alias("spans"))
    every = Window.partitionBy(F.lit(1))  # a row for each phase
    d = totals.withColumn("share", F.round(F.try_divide(F.col("ms"), F.sum("ms").over(every)), 6)).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("ms"), "phase")))
    return d.filter(F.col("rank") <= top).select("phase", (F.col("ms") / 1000).alias("total_s"), "spans", "share", "rank")


def phase_histogram(spans: DataFrame) -> DataFrame:
    """phase, le, n: cumulative counts of durations in fixed buckets, each phase's last bucket without bound."""
    bounds = F.array(*(F.lit(b) for b in BUCKETS), F.lit(float("inf")))
    return spans.select("phase", "duration_s", F.explode(bounds).alias("le")).groupBy("phase", "le").agg(F.count_if(F.col("duration_s") <= F.col("le")).alias("n"))


def histogram_quantile(buckets: DataFrame, q: float) -> DataFrame:
    """phase, value: the quantile by linear interpolation within the first bucket that reaches it; in the bucket without bound, the bound before."""
    w = Window.partitionBy("phase").orderBy("le")
    d = buckets.withColumn("below", F.coalesce(F.lag("n").over(w), F.lit(0))).withColumn("low", F.coalesce(F.lag("le").over(w), F.lit(0.0)))
    d = d.withColumn("total", F.max("n").over(Window.partitionBy("phase"))).withColumn("target", F.lit(q) * F.col("total"))
    d = d.filter((F.col("n") >= F.col("target")) & (F.col("total") > 0)).withColumn("_k", F.row_number().over(w)).filter("_k = 1")
    inside = F.when(F.col("n") == F.col("below"), F.col("low")).otherwise(F.col("low") + (F.col("le") - F.col("low")) * (F.col("target") - F.col("below")) / (F.col("n") - F.col("below")))
    return d.select("phase", F.round(F.when(F.col("le") == float("inf"), F.col("low")).otherwise(inside), 6).alias("value"))


def slowest(spans: DataFrame) -> DataFrame:
    """phase, event_id, duration_s of each phase's longest span; of equals the last."""
    return spans.groupBy("phase").agg(F.max_by("event_id", F.struct("duration_s", "event_id")).alias("event_id"), F.max("duration_s").alias("duration_s"))


def status_counts(rows: DataFrame, status: str, keys: list[str]) -> DataFrame:
    """status, n: a row for each of the keys, zero included, and one for all others."""
    known = F.when(F.col(status).isin(keys), F.col(status)).otherwise("other")
    counted = rows.groupBy(known.alias("status")).agg(F.count("*").alias("n"))
    return rows.sparkSession.createDataFrame([(k,) for k in [*keys, "other"]], "status string").join(counted, "status", "left").fillna(0)


def counter_deltas(samples: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """key, order, delta, reset_delta: difference from the sample before; null, or the value itself, where a counter went back."""
    w = Window.partitionBy(key).orderBy(order)
    d = samples.withColumn("_before", F.lag(value).over(w))
    back = F.col(value) < F.col("_before")
    return d.select(key, order, F.when(~back, F.col(value) - F.col("_before")).alias("delta"), F.when(F.col("_before").isNull() | back, F.col(value)).otherwise(F.col(value) - F.col("_before")).alias("reset_delta"))


def metric_lines(lines: DataFrame) -> DataFrame:
    """name, labels, value of text exposition lines name{labels} value; comments and other lines are left out."""
    pattern = r"^([a-zA-Z_:][a-zA-Z0-9_:]*)(?:\{([^}]*)\})?\s+(-?\d+(?:\.\d+)?)\s*$"
    d = lines.filter(F.col("value").rlike(pattern)).select(*(F.regexp_extract("value", pattern, i).alias(n) for i, n in ((1, "name"), (2, "raw"), (3, "number"))))
    pairs = F.transform(F.filter(F.split("raw", ","), lambda x: x.contains("=")), lambda x: F.struct(F.trim(F.split_part(x, F.lit("="), F.lit(1))).alias("key"), F.regexp_replace(F.trim(F.split_part(x, F.lit("="), F.lit(2))), '^"|"$', "").alias("value")))
    return d.select("name", F.map_from_entries(pairs).alias("labels"), F.col("number").cast("double").alias("value"))
