"""Scans of small text formats: id manifests, counter lines, JSON-lines logs, city tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def manifest_ids(lines: DataFrame) -> DataFrame:
    """id of each line (column value) that is a whole number once its # comment is cut off; each id once."""
    text = F.trim(F.split_part("value", F.lit("#"), F.lit(1)))
    return lines.select(F.when(text.rlike(r"^-?\d+$"), text).try_cast("long").alias("id")).filter("id IS NOT NULL").distinct()


def in_manifest(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key the manifest holds."""
    return rows.join(ids.withColumnRenamed("id", key), key, "left_semi")


def latest_counters(lines: DataFrame, prefix: str) -> DataFrame:
    """name, value of the k=v tokens in the last line (line_no, value) that holds the prefix as a word; whole numbers only, trailing commas cut off, the last of a name wins."""
    own = lines.filter(F.col("value").rlike(rf"\b{prefix}\b")).agg(F.max_by("value", "line_no").alias("value"))
    d = own.select(F.posexplode(F.regexp_extract_all("value", F.lit(r"(\S+=\S+)"), 1)).alias("at", "token"))
    d = d.select("at", F.split_part("token", F.lit("="), F.lit(1)).alias("name"), F.regexp_replace(F.split_part("token", F.lit("="), F.lit(2)), ",$", "").alias("raw"))
    return d.groupBy("name").agg(F.max_by(F.col("raw").try_cast("long"), "at").alias("value"))


def json_lines(spark: SparkSession, path: str, schema: StructType, mode: str = "FAILFAST") -> DataFrame:
    """A log with an object on each line. FAILFAST raises on a bad line, DROPMALFORMED skips it, PERMISSIVE keeps it as nulls."""
    return spark.read.schema(schema).json(path, mode=mode)


def city_table(spark: SparkSession, path: str) -> DataFrame:
    """The header CSV of cities, those whose division names a place, with its slug."""
    d = spark.read.csv(path, header=True)
    return d.filter(F.col("ocd_division_id").contains("/place:")).withColumn("slug", F.split_part("ocd_division_id", F.lit("/place:"), F.lit(2)))


#: What the fields of the rollout registry may hold.
WAVES, YES_NO, GATES, ROSTER_SOURCES = ("", "wave1", "wave2"), ("yes", "no"), ("pass", "fail", "pending", "insufficient_data"), ("", "legistar_office_records")
REGISTRY = ("city_slug", "wave", "enabled", "quality_gate", "stable_noop_eligible", "last_fresh_pass_run_id", "roster_source", "roster_body_name", "roster_source_verified_at")


def registry(spark: SparkSession, path: str) -> DataFrame:
    """The rollout registry's header CSV, fields trimmed, missing ones empty."""
    d = spark.read.csv(path, header=True)
    return d.select(*[F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c) if c in d.columns else F.lit("").alias(c) for c in REGISTRY])


def registry_violations(rows: DataFrame, cities: DataFrame) -> DataFrame:
    """city_slug, reason: every rule that a row of the registry breaks; cities: the known slugs (slug)."""
    many = rows.groupBy("city_slug").agg(F.count("*").alias("_n"))
    d = rows.join(many, "city_slug").join(cities.select(F.col("slug").alias("city_slug")).distinct().withColumn("_known", F.lit(True)), "city_slug", "left")
    slug, roster = F.col("city_slug"), ("roster_source", "roster_body_name", "roster_source_verified_at")
    given = sum(((F.col(c) != "").cast("int") for c in roster), F.lit(0))
    rules = {
        "missing_slug": slug == "",
        "invalid_slug": (slug != "") & ~slug.rlike("^[a-z0-9_]+$"),
        "duplicate_slug": (slug != "") & (F.col("_n") > 1),
        "invalid_wave": ~F.col("wave").isin(*WAVES),
        "invalid_enabled": ~F.col("enabled").isin(*YES_NO),
        "invalid_quality_gate": ~F.col("quality_gate").isin(*GATES),
        "invalid_stable_noop": ~F.col("stable_noop_eligible").isin(*YES_NO),
        "missing_noop_run": (F.col("stable_noop_eligible") == "yes") & (F.col("last_fresh_pass_run_id") == ""),
        "invalid_roster_source": ~F.col("roster_source").isin(*ROSTER_SOURCES),
        "incomplete_roster": ~given.isin(0, 3),
        "invalid_verified_at": (given == 3) & F.col("roster_source_verified_at").try_cast("date").isNull(),
        "unknown_city": (slug != "") & F.col("_known").isNull(),
    }
    return d.select("city_slug", F.explode(F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items())))).alias("reason"))


def day_summaries(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A summary for each run's folder, by its time (a file's own where it gives none), with day_no; a row for each day of the runs."""
    d = spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").json(path).withColumn("_at", F.coalesce("timestamp_epoch_s", F.unix_timestamp("_metadata.file_modification_time")))
    return d.withColumn("day_no", F.row_number().over(Window.orderBy("_at", "run_id"))).drop("_at")


def export_trends(counts: DataFrame, path: str, city: str, date_from: str, date_to: str) -> None:
    """topic, count, city, date_from, date_to as a header CSV."""
    counts.select("topic", "count", F.lit(city).alias("city"), F.lit(date_from).alias("date_from"), F.lit(date_to).alias("date_to")).write.csv(path, header=True)


def append_events(rows: DataFrame, path: str, event_type: str) -> None:
    """Append rows to a JSON-lines log as events of one type."""
    rows.select(F.lit(event_type).alias("event_type"), *rows.columns).write.mode("append").json(path)
