"""A run's files: literal cases, each fault by itself, and logs of bad lines."""

import hashlib
import json

import pytest

from gavel.operators import artifacts, evidence

RUN = "night"


def write(folder, **change):
    """A faultless run's files in folder; change replaces a file's contents (None: no file)."""
    ids = b"1\n2\n"
    profile = {**{k: "x" for k in artifacts.PROFILE}, "WORKER_CONCURRENCY": "3", "WORKER_POOL": "prefork", "WORKER_PROCESS_COMMAND": "run --concurrency=3 --pool=prefork"}
    manifest = {"run_id": RUN, "include_batch": True, "profile": profile, "source_manifest": "profiling/manifests/m.txt", "source_manifest_sha256": hashlib.sha256(ids).hexdigest(), "git_commit": "abc123", "tracked_tree_clean": True}
    result = {"run_id": RUN, "status": "completed", "error": None, "segments": [{"name": "pipeline", "status": "completed"}, {"name": "pipeline-batch", "status": "completed"}]}
    day = {"run_id": RUN, "provider_metrics_present": True, **{k: 2.0 for k in artifacts.DELTAS}, "search_p95_ms": 12}
    events = [{"run_id": RUN, "event_type": "phase_eligibility", "phase": p, "subject": s, "boundary": b, "eligible_ids": ids_, "eligible_count": len(ids_)} for p, s in (*evidence.ELIGIBILITY, *evidence.BATCH_ELIGIBILITY) for b, ids_ in (("before", [1, 2]), ("after", []))]
    events += [{"run_id": RUN, "event_type": "span", "phase": p, "outcome": "success"} for p in (*evidence.SPANS, *evidence.BATCH_SPANS)]
    log = b"summary_hydration_backfill selected=2 failed=0 embed_enqueued=0\nother words\n"
    files = {artifacts.MANIFEST: manifest, artifacts.RESULT: result, artifacts.DAY: day, artifacts.EVENTS: events, artifacts.LOG: log, artifacts.COPY: ids}
    files.update({k: change[v] for k, v in {artifacts.MANIFEST: "manifest", artifacts.RESULT: "result", artifacts.DAY: "day", artifacts.EVENTS: "events", artifacts.LOG: "log", artifacts.COPY: "copy"}.items() if v in change})
    folder.mkdir()
    for name, content in files.items():
        if callable(content):
            raise TypeError(name)
        if isinstance(content, list):
            content = "".join(json.dumps(x) + "\n" for x in content).encode()
        elif isinstance(content, dict):
            content = json.dumps(content, indent=1).encode()
        if content is not None:
            (folder / name).write_bytes(content)


def found(spark, root, *names, batch=True):
    runs = spark.createDataFrame([(n, RUN, batch) for n in names], "run string, run_id string, include_batch boolean")
    rows = artifacts.run_evidence(spark, str(root), runs).collect()
    return {n: sorted((r.kind, r.reason) for r in rows if r.run == n) for n in names}


@pytest.fixture(scope="module")
def reasons(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("runs")
    full = {"run_id": RUN, "event_type": "phase_eligibility", "phase": "summarize", "subject": "catalog"}
    dispatch = lambda b, **more: {"run_id": RUN, "event_type": "task_dispatch", "task_id": "t", "task_name": "semantic.embed_catalog", "retry_ordinal": 0, "boundary": b, **more}
    write(root / "good")
    write(root / "empty_events", events=b"")
    write(root / "blank_line", events=b'{"run_id": "night"}\n\n')
    write(root / "array_line", events=b"[1]\n")
    write(root / "no_files", manifest=None, result=b"nonsense", day=b"[]", events=None)
    write(root / "bad_log", log=b"summary_hydration_backfill embed_enqueued=5\n\xff\xfe failed=3\n")
    write(root / "empty_log", log=b"")
    write(root / "log", log=b"a failed=1 failed=0\nb xfailed=4 error=2 failed=1\nc other=-1 not_generated_yet=9\nsummary_hydration_backfill embed_enqueued=2\nsummary_hydration_backfill later\n")
    write(root / "copy", copy=b"1\n2")
    write(root / "events", events=[{**full, "boundary": "before", "eligible_ids": [2, 2], "eligible_count": 2}, {**full, "boundary": "after", "eligible_ids": [], "eligible_count": False}, dispatch("before"), dispatch("after"), dispatch("after")])
    return found(spark, root, "good", "empty_events", "blank_line", "array_line", "no_files", "bad_log", "empty_log", "log", "copy", "events", "absent"), root


def test_runs(reasons):
    got, _ = reasons
    phases = sorted([*(("reason", f"phase_eligibility_incomplete:{p}:{s}") for p, s in (*evidence.ELIGIBILITY, *evidence.BATCH_ELIGIBILITY)), *(("reason", f"phase_span_incomplete:{p}") for p in (*evidence.SPANS, *evidence.BATCH_SPANS)), ("reason", "initial_workload_missing")])
    assert got["good"] == [] and got["empty_log"] == []
    assert got["empty_events"] == phases
    assert got["blank_line"] == got["array_line"] == [("reason", "artifact_invalid:spans.jsonl")]
    every = [("reason", f"artifact_invalid:{n}") for n in sorted((artifacts.MANIFEST, artifacts.RESULT, artifacts.DAY, artifacts.EVENTS))]
    assert got["no_files"] == every and got["absent"] == every
    assert got["bad_log"] == [("reason", "artifact_invalid:commands.log")]
    assert got["log"] == [("reason", "side_effect_failure:error"), ("reason", "side_effect_failure:not_generated_yet"), ("reason", "task_dispatch_count_mismatch")]
    assert got["copy"] == [("reason", "source_manifest_copy_mismatch")]
    assert ("reason", "phase_eligibility_invalid:summarize:catalog") in got["events"] and ("reason", "unmatched_task_dispatch") in got["events"]


def test_bad_lines_are_kept_apart(spark, reasons):
    rows = artifacts.quarantined(spark, str(reasons[1])).collect()
    assert sorted((r.run, r.file, r.line) for r in rows) == [("array_line", artifacts.EVENTS, "[1]"), ("bad_log", artifacts.LOG, "�� failed=3"), ("blank_line", artifacts.EVENTS, "")]


def test_no_runs_and_no_folder(spark, tmp_path):
    assert found(spark, tmp_path / "none", batch=False) == {}
    assert found(spark, tmp_path / "none", "x")["x"][0] == ("reason", "artifact_invalid:day_summary.json")
