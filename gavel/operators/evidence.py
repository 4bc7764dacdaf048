"""Whether a run's events prove what it did: phases, dispatches, attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Phases whose eligible rows a run records before and after, phases with one span, phases that must leave nothing; the same of runs with the batch.
ELIGIBILITY = (("extract_parallel", "catalog"), ("segment_agenda", "catalog"), ("summarize", "catalog"))
SPANS = ("extract_parallel", "segment_agenda", "summarize", "pipeline_total")
BATCH_ELIGIBILITY = (("entity_backfill", "catalog"), ("table_extraction", "catalog"), ("org_backfill", "place"), ("org_backfill", "event"), ("topic_modeling", "catalog"))
BATCH_SPANS = ("entity_backfill", "table_extraction", "org_backfill", "topic_modeling", "batch_enrichment_total")
GATING = ("segment_agenda", "summarize", "entity_backfill", "table_extraction", "org_backfill", "topic_modeling")


def attempts(events: DataFrame) -> DataFrame:
    """run_id, task_id, retry: each attempt of a task with its counts of dispatches, starts, spans and failures, whether its dispatches are fair (each after follows a before of its own and none is left over), and done (fair and dispatched). Columns of a dispatch's name, if there, give the least and greatest name."""
    of = lambda kind: F.col("event_type") == kind
    named = events.filter("event_type IN ('task_dispatch', 'task_start', 'task_span') AND coalesce(trim(task_id), '') <> ''")
    attempt = ("run_id", "task_id", "retry")
    step = F.when(of("task_dispatch") & (F.col("boundary") == "before"), 1).when(of("task_dispatch") & (F.col("boundary") == "after"), -1).otherwise(0)
    open_ = F.sum("_step").over(Window.partitionBy(*attempt).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    stray = of("task_dispatch") & ~F.coalesce(F.col("boundary").isin("before", "after"), F.lit(False))
    name = F.when(of("task_dispatch"), F.coalesce("task_name", F.lit(""))) if "task_name" in events.columns else F.lit(None).cast("string")
    g = named.withColumn("_step", step).withColumn("_open", open_).withColumn("_name", name).groupBy(*attempt).agg(
        F.count_if(of("task_dispatch")).alias("dispatches"), F.min("_open").alias("least"), F.sum("_step").alias("left"), F.count_if(stray).alias("stray"), F.count_if(of("task_start")).alias("starts"), F.count_if(of("task_span")).alias("spans"),
        F.count_if(of("task_span") & ~F.col("outcome").eqNullSafe(F.lit("success"))).alias("failures"), F.min("_name").alias("least_name"), F.max("_name").alias("greatest_name"),
    )
    return g.withColumn("fair", (F.col("least") >= 0) & (F.col("left") == 0) & (F.col("stray") == 0)).withColumn("done", F.col("fair") & (F.col("dispatches") > 0))


def task_reasons(events: DataFrame) -> DataFrame:
    """run_id, reason: what is wrong with a run's tasks, each once.

    events: run_id, seq (order), event_type (task_dispatch, task_start, task_span), task_id, retry, boundary (before, after), execution_id, outcome. Where events have retry_given (whether the event says anything of its retry), a null retry is unknown only if it is given.
    """
    d = events.filter("event_type IN ('task_dispatch', 'task_start', 'task_span')")
    of = lambda kind: F.col("event_type") == kind
    unknown = d.filter("retry IS NULL" + (" AND retry_given" if "retry_given" in d.columns else "")).select("run_id", F.lit("unknown_task_retry_ordinal").alias("reason"))
    g = attempts(events)
    rules = {
        "unmatched_task_dispatch": (F.col("dispatches") > 0) & ~F.col("fair"),
        "task_start_missing": F.col("done") & (F.col("starts") == 0),
        "task_terminal_missing": F.col("done") & (F.col("spans") == 0),
        "missing_task_dispatch": ~F.col("done") & (F.col("retry") == 0) & (F.col("starts") > 0),
        "missing_retry_dispatch": ~F.col("done") & (F.col("retry") > 0) & (F.col("starts") + F.col("spans") > 0),
    }
    broken = g.select("run_id", F.explode(F.array_compact(F.array(*(F.when(c, n) for n, c in rules.items())))).alias("reason"))
    ended = F.when(F.col("spans") > 0, F.struct(F.coalesce("retry", F.lit(-1)).alias("retry"), (F.col("failures") > 0).alias("failed")))
    last = g.groupBy("run_id", "task_id").agg(F.max(ended).alias("last"), F.bool_or("done").alias("done"))
    failed = last.filter("done AND (last.failed OR last.retry < 0)").select("run_id", F.lit("task_terminal_failed").alias("reason"))
    x = d.filter("coalesce(execution_id, '') <> ''").groupBy("run_id", "execution_id").agg(F.bool_or(of("task_start")).alias("start"), F.bool_or(of("task_span")).alias("span"))
    loose = x.select("run_id", F.when(F.col("start") & ~F.col("span"), "unfinished_task_attempt").when(F.col("span") & ~F.col("start"), "orphan_task_terminal").alias("reason")).filter("reason IS NOT NULL")
    return unknown.unionByName(broken).unionByName(failed).unionByName(loose).distinct()


def phase_reasons(events: DataFrame, runs: DataFrame) -> DataFrame:
    """run_id, kind (reason or warning), reason: what is wrong with the phases of each of runs (run_id; include_batch, if there, tells of which runs the batch's phases are asked too).

    events: run_id, event_type (phase_eligibility, span), phase, subject, boundary, eligible_count, ids (array of long), outcome.
    """
    ids = F.col("ids")
    valid = F.col("eligible_count").isNotNull() & ids.isNotNull() & (F.col("eligible_count") == F.size(ids)) & F.forall(ids, lambda x: F.coalesce(x > 0, F.lit(False))) & (ids == F.array_sort(F.array_distinct(ids)))
    e = events.filter("event_type = 'phase_eligibility'").withColumn("_valid", F.coalesce(valid, F.lit(False)))
    when = lambda b: F.col("boundary") == b
    e = e.groupBy("run_id", "phase", "subject").agg(F.count("*").alias("n"), F.count_if(when("before")).alias("before"), F.count_if(when("after")).alias("after"), F.bool_and("_valid").alias("valid"), F.sum(F.when(when("before") & F.col("_valid"), F.col("eligible_count"))).alias("work"), F.sum(F.when(when("after") & F.col("_valid"), F.col("eligible_count"))).alias("rest"))
    batch = F.coalesce("include_batch", F.lit(False)) if "include_batch" in runs.columns else F.lit(False)
    asked = lambda core, more: F.when(batch, F.array(*core, *more)).otherwise(F.array(*core))
    subjects = lambda rows: [F.struct(F.lit(a).alias("phase"), F.lit(b).alias("subject")) for a, b in rows]
    p = runs.select("run_id", F.inline(asked(subjects(ELIGIBILITY), subjects(BATCH_ELIGIBILITY)))).distinct()
    p = p.join(e, ["run_id", "phase", "subject"], "left")
    full = F.coalesce((F.col("n") == 2) & (F.col("before") == 1) & (F.col("after") == 1), F.lit(False))
    rest = F.coalesce("rest", F.lit(0)) > 0
    name = lambda kind: F.concat_ws(":", F.lit(kind), "phase", "subject")
    found = F.array(
        F.when(~full, F.struct(F.lit("reason").alias("kind"), name("phase_eligibility_incomplete").alias("reason"))),
        F.when(full & ~F.col("valid"), F.struct(F.lit("reason").alias("kind"), name("phase_eligibility_invalid").alias("reason"))),
        F.when(full & rest & (F.col("phase") == "extract_parallel"), F.struct(F.lit("warning").alias("kind"), F.lit("extraction_remainder_nonzero").alias("reason"))),
        F.when(full & rest & F.col("phase").isin(*GATING), F.struct(F.lit("reason").alias("kind"), name("phase_remainder_nonzero").alias("reason"))),
    )
    phases = p.select("run_id", F.explode(F.array_compact(found)).alias("x")).select("run_id", "x.kind", "x.reason")
    idle = p.groupBy("run_id").agg(F.sum(F.when(full, F.coalesce("work", F.lit(0))).otherwise(0)).alias("work")).filter("work = 0").select("run_id", F.lit("reason").alias("kind"), F.lit("initial_workload_missing").alias("reason"))
    s = events.filter("event_type = 'span'").groupBy("run_id", "phase").agg(F.count("*").alias("n"), F.bool_and(F.col("outcome").eqNullSafe(F.lit("success"))).alias("ok"))
    s = runs.select("run_id", F.explode(asked([F.lit(x) for x in SPANS], [F.lit(x) for x in BATCH_SPANS])).alias("phase")).distinct().join(s, ["run_id", "phase"], "left")
    once = F.coalesce(F.col("n") == 1, F.lit(False))
    spans = s.select("run_id", F.lit("reason").alias("kind"), F.when(~once, F.concat(F.lit("phase_span_incomplete:"), "phase")).when(~F.col("ok"), F.concat(F.lit("phase_span_failed:"), "phase")).alias("reason")).filter("reason IS NOT NULL")
    return phases.unionByName(idle).unionByName(spans)
