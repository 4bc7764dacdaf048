"""Whole runs from their files: manifest, result, day summary, events and log, each read as strictly as it must be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gavel.operators import evidence
from gavel.plans.tables import _path, checkpointed

# A run's files, its segments, and the counters that tell of failures, of which a line's first above zero is told.
MANIFEST, RESULT, DAY, EVENTS, LOG, COPY = "run_manifest.json", "result.json", "day_summary.json", "spans.jsonl", "commands.log", "catalog_manifest.txt"
SEGMENTS, BATCH_SEGMENTS = ("pipeline",), ("pipeline-batch",)
FAILURES = ("reindex_failed", "embed_dispatch_failed", "not_generated_yet", "other", "error", "failed")
BACKFILL, ENQUEUED, EMBED_TASK = "summary_hydration_backfill", "embed_enqueued", "semantic.embed_catalog"
DELTAS = ("provider_requests_delta_run", "provider_timeouts_delta_run", "provider_retries_delta_run")
MANIFEST_HOME = "profiling/manifests/"
# What a run's profile must name.
PROFILE = (
    "LOCAL_AI_BACKEND", "LOCAL_AI_HTTP_API", "LOCAL_AI_HTTP_PROFILE", "LOCAL_AI_HTTP_MODEL", "LOCAL_AI_HTTP_TIMEOUT_SECONDS", "LOCAL_AI_HTTP_TIMEOUT_SEGMENT_SECONDS", "LOCAL_AI_HTTP_TIMEOUT_SUMMARY_SECONDS", "LOCAL_AI_HTTP_TIMEOUT_TOPICS_SECONDS", "LOCAL_AI_HTTP_MAX_RETRIES", "WORKER_CONCURRENCY", "WORKER_POOL",
    "OLLAMA_NUM_PARALLEL", "SEMANTIC_BACKEND", "SEMANTIC_CONTENT_MAX_CHARS", "SEMANTIC_ENABLED", "SEMANTIC_MODEL_NAME", "WORKER_PROCESS_COMMAND", "SEMANTIC_WORKER_PROCESS_COMMAND",
)

#: Where a run's files lie: a folder for each run, or a folder for each file name with a folder for each run, as partitioned writes leave them.
BY_RUN, BY_FILE = "{root}/*/{name}", "{root}/{name}/*/*"

_RUN = r"/(?:[^/=]+=)?([^/]+)/[^/]+$"


def _read(spark: SparkSession, root: str, layout: str, name: str, form: str, **options) -> DataFrame:
    """The files of one name, with run (the folder they lie in, without a partition's key) and _at (the place of a row in its file)."""
    glob = layout.format(root=root, name=name)
    system, path = _path(spark, glob)
    found = system.globStatus(path)
    kind = "content binary" if form == "binaryFile" else "value string"
    if found is None or len(found) == 0:
        return spark.createDataFrame([], f"run string, {kind}, _at struct<start: bigint, row: bigint>")
    d = spark.read.format(form).options(**options).load(glob)
    run = F.regexp_extract("_metadata.file_path", _RUN, 1)
    at = F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    return d.select(run.alias("run"), kind.split()[0], at.alias("_at"))


def _document(d: DataFrame, name: str) -> DataFrame:
    """run, and the JSON object that the run's file of this name holds, null if it holds none."""
    parsed = F.try_parse_json("value")
    return d.withColumn(name, F.when(F.schema_of_variant(parsed).startswith("OBJECT"), parsed)).groupBy("run").agg(F.first(name).alias(name))


def _value(c: str, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(c, path, kind)


def _kind(c: str | Column, path: str | None = None) -> Column:
    """The kind of a value within a variant; empty if there is none, VOID if it is null."""
    v = F.try_variant_get(c, path, "variant") if path else c
    return F.coalesce(F.schema_of_variant(v), F.lit(""))


def _is_number(c: str, path: str) -> Column:
    return _kind(c, path).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")


def _is_true(c: str, path: str) -> Column:
    return (_kind(c, path) == "BOOLEAN") & F.coalesce(_value(c, path, "boolean"), F.lit(False))


def events_of(lines: DataFrame) -> DataFrame:
    """Events (run_id is the run's folder) of a log's lines, with valid: whether the line is an object."""
    d = lines.withColumn("v", F.try_parse_json("value"))
    d = d.withColumn("valid", F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False)))
    whole = lambda p: F.when(_kind("v", p) == "BIGINT", _value("v", p, "long"))
    ids = F.when(_kind("v", "$.eligible_ids").isin("ARRAY<BIGINT>", "ARRAY<VOID>"), _value("v", "$.eligible_ids", "array<bigint>"))
    texts = [_value("v", f"$.{c}").alias(c) for c in ("event_type", "phase", "subject", "boundary", "outcome", "task_id", "task_name", "execution_id")]
    return d.select(
        F.col("run").alias("run_id"), F.col("_at").alias("seq"), "valid", _value("v", "$.run_id").alias("said"), *texts, whole("$.retry_ordinal").alias("retry"), (_kind("v", "$.retry_ordinal") != "").alias("retry_given"), whole("$.eligible_count").alias("eligible_count"), ids.alias("ids")
    )


def quarantined(spark: SparkSession, root: str, layout: str = BY_RUN) -> DataFrame:
    """run, file, line: the lines of event logs that are no JSON objects, and those of command logs that are no UTF-8."""
    events = _read(spark, root, layout, EVENTS, "text")
    parsed = F.schema_of_variant(F.try_parse_json("value"))
    bad = events.filter(~F.coalesce(parsed.startswith("OBJECT"), F.lit(False))).select("run", F.lit(EVENTS).alias("file"), F.col("value").alias("line"))
    log = _read(spark, root, layout, LOG, "text").filter(~F.is_valid_utf8("value")).select("run", F.lit(LOG).alias("file"), F.make_valid_utf8("value").alias("line"))
    return bad.unionByName(log)


def run_evidence(spark: SparkSession, root: str, runs: DataFrame, layout: str = BY_RUN) -> DataFrame:
    """run, kind (reason or warning), reason: all that speaks against each of runs (run: its folder; run_id: the id it must bear; include_batch), each once.

    If its manifest, result, day summary or events are missing or unreadable (one bad line of the events is enough), only that is said. Of a log of commands only lines that are not UTF-8 are unreadable. Events and logs are read line by line, so their size is not bounded by a task's memory; the small files whole.
    """
    whole = {n: _document(_read(spark, root, layout, n, "text", wholetext="true"), c) for n, c in ((MANIFEST, "manifest"), (RESULT, "result"), (DAY, "day"))}
    # events are parsed once and read by several rules
    events = checkpointed(events_of(_read(spark, root, layout, EVENTS, "text")))
    said = events.groupBy("run_id").agg(F.bool_and("valid").alias("events_valid"), F.min("said").alias("least_said"), F.max("said").alias("greatest_said")).withColumnRenamed("run_id", "run")
    lines = checkpointed(log_lines(_read(spark, root, layout, LOG, "text")))
    logs = lines.groupBy("run").agg(F.bool_and("valid").alias("log_valid"), F.max_by("enqueued", F.when(F.col("enqueued").isNotNull(), F.col("at"))).alias("expected"))
    copies = _read(spark, root, layout, COPY, "binaryFile").groupBy("run").agg(F.first(F.sha2("content", 256)).alias("copy_sha"))
    d = runs.select("run", "run_id", "include_batch").distinct()
    for more in (*whole.values(), said, logs, copies, _present(spark, root, layout, EVENTS, "has_events"), _present(spark, root, layout, LOG, "has_log")):
        d = d.join(more, "run", "left")
    # an empty file has no bad line
    d = d.withColumn("log_valid", F.coalesce("log_valid", "has_log", F.lit(False))).withColumn("events_valid", F.coalesce("events_valid", "has_events", F.lit(False)))
    broken = {MANIFEST: F.col("manifest").isNull(), RESULT: F.col("result").isNull(), DAY: F.col("day").isNull(), EVENTS: ~F.col("events_valid")}
    invalid = F.array_compact(F.array(*(F.when(c, F.lit(f"artifact_invalid:{n}")) for n, c in broken.items())))
    d = checkpointed(d.withColumn("invalid", invalid).select("run", "include_batch", "expected", "log_valid", "invalid", document_reasons().alias("found")))
    readable = d.filter(F.size("invalid") == 0).select(F.col("run").alias("run_id"), "include_batch", "expected")
    own = events.join(readable.select("run_id"), "run_id", "left_semi")
    phases = evidence.phase_reasons(own, readable)
    tasks = evidence.task_reasons(own)
    sent = evidence.attempts(own).filter((F.col("retry") == 0) & F.col("done") & (F.col("least_name") == EMBED_TASK) & (F.col("greatest_name") == EMBED_TASK)).groupBy("run_id").agg(F.count("*").alias("sent"))
    fewer = readable.join(sent, "run_id", "left").filter(F.coalesce("sent", F.lit(0)) < F.coalesce("expected", F.lit(0))).select("run_id", F.lit("task_dispatch_count_mismatch").alias("reason"))
    failed = lines.filter("failure IS NOT NULL").select(F.col("run").alias("run_id"), F.concat(F.lit("side_effect_failure:"), "failure").alias("reason"))
    # a log that cannot be read tells no counts
    legible = d.filter("log_valid").select(F.col("run").alias("run_id"))
    counted = fewer.unionByName(failed.join(readable.select("run_id"), "run_id", "left_semi")).join(legible, "run_id", "left_semi")
    plain = tasks.unionByName(counted).withColumn("kind", F.lit("reason")).unionByName(phases)
    documents = d.select(F.col("run").alias("run_id"), F.explode(F.when(F.size("invalid") > 0, F.col("invalid")).otherwise(F.col("found"))).alias("reason")).withColumn("kind", F.lit("reason"))
    return plain.unionByName(documents).distinct().select(F.col("run_id").alias("run"), "kind", "reason")


def _present(spark: SparkSession, root: str, layout: str, name: str, flag: str) -> DataFrame:
    """run and a flag that is true: the runs that have a file of this name, be it empty. Scans skip empty files, so this is asked of the listing that every scan makes."""
    glob = layout.format(root=root, name=name)
    system, path = _path(spark, glob)
    found = system.globStatus(path)
    paths = spark.read.format("binaryFile").load(glob).inputFiles() if found is not None and len(found) else []
    listed = spark.createDataFrame([(p,) for p in paths], "path string")
    return listed.select(F.regexp_extract("path", _RUN, 1).alias("run"), F.lit(True).alias(flag)).distinct()


def log_lines(lines: DataFrame) -> DataFrame:
    """run, at, valid (UTF-8), failure (the first of FAILURES above zero), enqueued (of lines on the summary backfill): the counters of each line, of a name twice the last."""
    text = F.when(F.is_valid_utf8("value"), F.col("value"))
    last = lambda name: F.try_element_at(F.regexp_extract_all(text, F.lit(rf"(?<![a-zA-Z_]){name}=(-?\d+)\b"), F.lit(1)), F.lit(-1)).try_cast("decimal(38,0)")
    failure = F.coalesce(*(F.when(last(n) > 0, F.lit(n)) for n in FAILURES))
    return lines.select("run", F.col("_at").alias("at"), F.is_valid_utf8("value").alias("valid"), failure.alias("failure"), F.when(text.contains(BACKFILL), last(ENQUEUED)).alias("enqueued"))


def document_reasons() -> Column:
    """What speaks against a run by its manifest, result, day summary, ids and log's state: an array, of columns manifest, result, day, run_id, include_batch, least_said, greatest_said, log_valid and copy_sha."""
    ids = F.array_compact(F.array(_value("manifest", "$.run_id"), _value("result", "$.run_id"), _value("day", "$.run_id"), F.col("least_said"), F.col("greatest_said")))
    segments = F.try_variant_get("result", "$.segments", "array<variant>")
    ended = F.filter(segments, lambda s: F.coalesce(F.try_variant_get(s, "$.status", "string") == "completed", F.lit(False)))
    names = F.transform(ended, lambda s: F.coalesce(F.try_variant_get(s, "$.name", "string"), F.lit("None")))
    core, more = ([F.lit(x) for x in SEGMENTS], [F.lit(x) for x in BATCH_SEGMENTS])
    asked = F.when(F.col("include_batch"), F.array(*core, *more)).otherwise(F.array(*core))
    sha = F.when(_kind("manifest", "$.source_manifest_sha256") == "STRING", _value("manifest", "$.source_manifest_sha256"))
    text = lambda p: F.when(_kind("manifest", p) == "STRING", _value("manifest", p))
    sourced = text("$.source_manifest").startswith(MANIFEST_HOME) & sha.rlike(r"\A[0-9a-f]{64}\z") & (F.trim(text("$.git_commit")) != "") & _is_true("manifest", "$.tracked_tree_clean")
    named = lambda k: (F.trim(F.coalesce(_value("manifest", f"$.profile.{k}"), F.lit(""))) != "") & ~_kind("manifest", f"$.profile.{k}").startswith("VOID") & ~F.coalesce(_value("manifest", f"$.profile.{k}").isin("0", "0.0", "false", "[]", "{}") & (_kind("manifest", f"$.profile.{k}") != "STRING"), F.lit(False))
    complete = _kind("manifest", "$.profile").startswith("OBJECT")
    for k in PROFILE:
        complete = complete & named(k)
    command = _value("manifest", "$.profile.WORKER_PROCESS_COMMAND")
    runs_so = command.contains(F.concat(F.lit("--concurrency="), _value("manifest", "$.profile.WORKER_CONCURRENCY"))) & command.contains(F.concat(F.lit("--pool="), _value("manifest", "$.profile.WORKER_POOL")))
    measured = _is_true("day", "$.provider_metrics_present")
    for k in DELTAS:
        measured = measured & _is_number("day", f"$.{k}")
    holds = lambda c: F.coalesce(c, F.lit(False))
    rules = {
        "run_id_mismatch": ~holds((F.size(ids) > 0) & F.forall(ids, lambda x: x == F.col("run_id"))),
        "result_not_completed": ~holds((_value("result", "$.status") == "completed") & _kind("result", "$.error").isin("", "VOID")),
        "segments_incomplete": ~holds(_kind("result", "$.segments").startswith("ARRAY") & (names == asked)),
        "include_batch_mismatch": ~holds((_kind("manifest", "$.include_batch") == "BOOLEAN") & (_value("manifest", "$.include_batch", "boolean") == F.col("include_batch"))),
        "source_provenance_incomplete": ~holds(sourced),
        f"artifact_invalid:{COPY}": F.col("copy_sha").isNull(),
        "source_manifest_copy_mismatch": F.col("copy_sha").isNotNull() & ~F.col("copy_sha").eqNullSafe(sha),
        f"artifact_invalid:{LOG}": ~holds(F.col("log_valid")),
        "provider_deltas_incomplete": ~holds(measured),
        "search_measurement_missing": ~_is_number("day", "$.search_p95_ms"),
        "runtime_profile_incomplete": ~holds(complete),
        "runtime_profile_process_mismatch": holds(complete) & ~holds(runs_so),
    }
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())))
