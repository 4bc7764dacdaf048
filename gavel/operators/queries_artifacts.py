"""Queries of whole runs' files, with their DuckDB twins."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from gavel.operators import artifacts, evidence
from gavel.operators.queries_documents import folder, quoted
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


#: Runs are numbered 0 to 39 by customer; each order is a task of its customer's run. What is wrong with a run goes by its number; below, what is to be found of it.
RUNS = "(SELECT DISTINCT o_custkey % 40 AS n FROM {orders})"
TASKS = "(SELECT o_custkey % 40 AS n, o_orderkey, CASE WHEN o_custkey % 40 BETWEEN 27 AND 35 AND o_orderkey % 8 = 0 THEN o_custkey % 40 ELSE 0 END AS fault FROM {orders})"
FOUND = """
3 reason artifact_invalid:run_manifest.json
4 reason artifact_invalid:result.json
5 reason artifact_invalid:day_summary.json
6 reason artifact_invalid:spans.jsonl
7 reason run_id_mismatch
8 reason result_not_completed
9 reason result_not_completed
10 reason segments_incomplete
11 reason include_batch_mismatch
12 reason source_provenance_incomplete
13 reason source_provenance_incomplete
13 reason source_manifest_copy_mismatch
14 reason artifact_invalid:catalog_manifest.txt
15 reason source_manifest_copy_mismatch
16 reason artifact_invalid:commands.log
17 reason side_effect_failure:failed
17 reason side_effect_failure:reindex_failed
18 reason task_dispatch_count_mismatch
19 reason provider_deltas_incomplete
20 reason provider_deltas_incomplete
21 reason search_measurement_missing
22 reason runtime_profile_incomplete
23 reason runtime_profile_process_mismatch
24 reason source_provenance_incomplete
25 reason segments_incomplete
26 reason run_id_mismatch
27 reason unmatched_task_dispatch
27 reason missing_task_dispatch
28 reason task_start_missing
28 reason orphan_task_terminal
29 reason task_terminal_missing
29 reason unfinished_task_attempt
30 reason unknown_task_retry_ordinal
30 reason task_terminal_failed
31 reason task_terminal_failed
32 reason missing_retry_dispatch
33 reason unfinished_task_attempt
33 reason orphan_task_terminal
34 reason unmatched_task_dispatch
34 reason missing_task_dispatch
35 reason task_terminal_failed
36 reason phase_eligibility_incomplete:segment_agenda:catalog
37 reason phase_eligibility_invalid:summarize:catalog
38 warning extraction_remainder_nonzero
38 reason phase_remainder_nonzero:org_backfill:event
39 reason phase_span_failed:summarize
39 reason phase_span_incomplete:pipeline_total
"""

_PROFILE = json.dumps({**{k: "x" for k in artifacts.PROFILE}, "WORKER_CONCURRENCY": "3", "WORKER_POOL": "prefork", "WORKER_PROCESS_COMMAND": "run --concurrency=3 --pool=prefork"}).replace("{", "<").replace("}", ">")


def _files(t: Tables) -> dict:
    """For each file name, (run, seq, value): the lines of the runs' files, derived from every order. Braces would name tables in the SQL, so < and > stand for them till the end."""
    runs = "SELECT n, concat('r', n) AS run, n % 2 = 0 AS batch, concat('1', chr(10), n) AS ids FROM " + RUNS + " r"
    manifest = (
        "concat('<\"run_id\": \"r', n, '\", \"include_batch\": ', CASE WHEN batch = (n <> 11) THEN 'true' ELSE 'false' END, ', \"source_manifest\": \"', CASE n WHEN 12 THEN 'elsewhere/' ELSE 'profiling/manifests/' END, 'm.txt\", \"source_manifest_sha256\": \"', CASE n WHEN 13 THEN 'none' ELSE sha2(concat(ids, chr(10)), 256) END, "
        "'\", \"git_commit\": \"abc\", \"tracked_tree_clean\": ', CASE n WHEN 24 THEN '1' ELSE 'true' END, ', \"profile\": ', CASE n WHEN 22 THEN replace(" + quoted(_PROFILE) + ", '\"prefork\"', '\" \"') WHEN 23 THEN replace(" + quoted(_PROFILE) + ", 'run --concurrency=3', 'run --concurrency=4') ELSE " + quoted(_PROFILE) + " END, '>')"
    )
    result = (
        "CASE n WHEN 4 THEN '[1]' ELSE concat('<\"run_id\": \"r', n, '\",', chr(10), ' \"status\": \"', CASE n WHEN 8 THEN 'failed' ELSE 'completed' END, '\", \"error\": ', CASE n WHEN 9 THEN '\"x\"' ELSE 'null' END, ', \"segments\": ', CASE n WHEN 25 THEN '\"pipeline\"' ELSE concat('[<\"name\": \"pipeline\", \"status\": \"completed\">, 5', "
        "CASE WHEN batch THEN concat(', <\"name\": \"pipeline-batch\", \"status\": \"', CASE n WHEN 10 THEN 'running' ELSE 'completed' END, '\">') ELSE '' END, ']') END, '>') END"
    )
    day = "CASE n WHEN 5 THEN '<' ELSE concat('<\"run_id\": \"', CASE n WHEN 7 THEN 'other' ELSE run END, '\", \"provider_metrics_present\": ', CASE n WHEN 19 THEN 'false' ELSE 'true' END, ', \"provider_requests_delta_run\": 2.0, \"provider_timeouts_delta_run\": ', CASE n WHEN 20 THEN '\"0\"' ELSE '0' END, ', \"provider_retries_delta_run\": 1e0, \"search_p95_ms\": ', CASE n WHEN 21 THEN 'null' ELSE '12.5' END, '>') END"
    log = (
        "concat('agenda_segmentation_backfill selected=1 failed=', CASE n WHEN 17 THEN 1 ELSE 0 END, ' other=0', chr(10), 'summary_hydration_backfill error=0 embed_enqueued=', CASE n WHEN 18 THEN 1 + (SELECT count(*) FROM {orders} o) ELSE 1 END, chr(10), 'summary_hydration_backfill complete=2', CASE n WHEN 17 THEN ' failed=2 reindex_failed=3' ELSE '' END)"
    )
    pick = lambda value, but: from_sql(t, f"SELECT run, 0 AS seq, {value} AS value FROM ({runs}) r WHERE n <> {but}")
    # events: four of each order's task, and those of the phases
    name = "concat('<\"run_id\": \"', CASE n WHEN 26 THEN 'stray' ELSE concat('r', n) END, '\", \"task_id\": \"t', o_orderkey, '\", \"task_name\": \"semantic.embed_catalog\"', CASE WHEN fault = 35 THEN '' WHEN fault = 30 THEN ', \"retry_ordinal\": null' ELSE concat(', \"retry_ordinal\": ', retry) END, "
    steps = "(SELECT x.*, k, CASE WHEN k > 3 THEN 1 ELSE 0 END AS retry FROM " + TASKS + " x JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k UNION ALL SELECT 2 AS k UNION ALL SELECT 3 AS k UNION ALL SELECT 4 AS k UNION ALL SELECT 5 AS k) y ON (k < 4 OR fault = 32) AND NOT (fault = 27 AND k = 1) AND NOT (fault = 28 AND k = 2) AND NOT (fault = 29 AND k = 3))"
    execution = "', \"execution_id\": \"e', o_orderkey, '-', retry, CASE WHEN fault = 33 AND k = 3 THEN 'x' ELSE '' END, '\"'"
    task = name + "CASE WHEN k < 2 THEN concat(', \"event_type\": \"task_dispatch\", \"boundary\": \"', CASE WHEN k = 0 THEN 'before' WHEN fault = 34 THEN 'during' ELSE 'after' END, '\"') WHEN k % 2 = 0 THEN concat(', \"event_type\": \"task_start\"', " + execution + ") ELSE concat(', \"event_type\": \"task_span\", \"outcome\": \"', CASE fault WHEN 31 THEN 'failed' ELSE 'success' END, '\"', " + execution + ") END, '>')"
    pairs = " UNION ALL ".join(f"SELECT '{a}' AS phase, '{b}' AS subject, {more} AS more" for rows, more in ((evidence.ELIGIBILITY, "FALSE"), (evidence.BATCH_ELIGIBILITY, "TRUE")) for a, b in rows)
    spans = " UNION ALL ".join(f"SELECT '{a}' AS phase, {more} AS more" for rows, more in ((evidence.SPANS, "FALSE"), (evidence.BATCH_SPANS, "TRUE")) for a in rows)
    left = "((n = 38 AND phase = 'extract_parallel') OR (n = 38 AND subject = 'event'))"
    eligible = (
        "concat('<\"event_type\": \"phase_eligibility\", \"phase\": \"', phase, '\", \"subject\": \"', subject, '\", \"boundary\": \"', boundary, '\", \"eligible_ids\": ', CASE WHEN boundary = 'before' OR " + left + " THEN '[1, 2]' ELSE '[]' END, ', \"eligible_count\": ', "
        "CASE WHEN n = 37 AND phase = 'summarize' THEN '\"2\"' WHEN boundary = 'before' OR " + left + " THEN '2' ELSE '0' END, '>')"
    )
    span = "concat('<\"event_type\": \"span\", \"run_id\": \"r', n, '\", \"phase\": \"', phase, '\", \"outcome\": \"', CASE WHEN n = 39 AND phase = 'summarize' THEN 'failed' ELSE 'success' END, '\">')"
    events = from_sql(
        t,
        f"SELECT concat('r', n) AS run, o_orderkey * 10 + k AS seq, {task} AS value FROM {steps} s UNION ALL SELECT run, -1 AS seq, {eligible} AS value FROM ({runs}) r JOIN ({pairs}) p ON batch OR NOT more JOIN (SELECT 'before' AS boundary UNION ALL SELECT 'after' AS boundary) b ON NOT (n = 36 AND boundary = 'after' AND phase = 'segment_agenda') "
        f"UNION ALL SELECT run, -1 AS seq, {span} AS value FROM ({runs}) r JOIN ({spans}) p ON batch OR NOT more WHERE n <> 26 UNION ALL SELECT run, -1 AS seq, {span} AS value FROM ({runs}) r JOIN (SELECT 'pipeline_total' AS phase) p ON n = 39 UNION ALL SELECT run, -1 AS seq, 'not an object' AS value FROM ({runs}) r WHERE n = 6 "
        f"UNION ALL SELECT run, -1 AS seq, replace({span}, 'r26', 'stray') AS value FROM ({runs}) r JOIN ({spans}) p ON batch OR NOT more WHERE n = 26",
    )
    copies = pick("CASE n WHEN 15 THEN '9' ELSE ids END", 14)
    files = {artifacts.MANIFEST: pick(manifest, 3), artifacts.RESULT: pick(result, -1), artifacts.DAY: pick(day, -1), artifacts.LOG: pick(log, 16), artifacts.COPY: copies, artifacts.EVENTS: events}
    return {name: rows.withColumn("value", F.translate("value", "<>", "{}")) for name, rows in files.items()}


_VALUES = ", ".join(f"({n}, {quoted(kind)}, {quoted(reason)})" for n, kind, reason in (line.split() for line in FOUND.strip().splitlines()))


@query("SELECT concat('r', r.n) AS run, v.kind, v.reason FROM " + RUNS + " r JOIN (VALUES " + _VALUES + ") v(n, kind, reason) ON v.n = r.n WHERE r.n NOT BETWEEN 27 AND 35 OR r.n IN (SELECT fault FROM " + TASKS + " x)")
def a21_run_evidence(t):
    path = folder(t)
    for name, rows in _files(t).items():
        # a run's events lie in one file in their order
        rows.repartition("run").sortWithinPartitions("run", "seq").select("run", "value").write.partitionBy("run").text(f"{path}/{name}")
    runs = from_sql(t, "SELECT concat('r', n) AS run, concat('r', n) AS run_id, n % 2 = 0 AS include_batch FROM " + RUNS + " r")
    return artifacts.run_evidence(t._spark, path, runs, artifacts.BY_FILE)
