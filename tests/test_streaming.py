import datetime as dt

from pyspark.sql import functions as F

from gavel.streaming import jobs

DAY = dt.date(2024, 1, 1)
STAGE = "id long, ocd_division_id string, record_date date, name string"


def test_promotion_stream_is_idempotent(spark, tmp_path):
    place = spark.createDataFrame([(1, "ocd-a")], "id long, ocd_division_id string")
    events, inbox = str(tmp_path / "events"), str(tmp_path / "inbox")
    spark.createDataFrame([(1, DAY, "Council")], "place_id long, record_date date, name string").write.parquet(events)

    def write(rows, number):
        rows.select("place_id", "record_date", "name").write.mode("append").parquet(events)

    def run(checkpoint):
        stream = jobs.parquet_stream(spark, inbox, spark.createDataFrame([], STAGE).schema)
        jobs.promote_stream(stream, lambda: spark.read.parquet(events), place, write, str(tmp_path / checkpoint)).awaitTermination(120)

    spark.createDataFrame([(1, "ocd-a", DAY, "Council"), (2, "ocd-a", None, "Parks"), (3, "ocd-a", None, "Parks"), (4, "ocd-b", DAY, "X")], STAGE).write.parquet(inbox)
    run("c1")
    assert spark.read.parquet(events).count() == 2
    run("c2")  # replayed from the start: nothing is promoted twice
    assert spark.read.parquet(events).count() == 2
    spark.createDataFrame([(5, "ocd-a", DAY, "Parks")], STAGE).write.mode("append").parquet(inbox)
    run("c1")
    assert spark.read.parquet(events).count() == 3


def test_histogram_stream_equals_its_table(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    spans = spark.createDataFrame([(start + dt.timedelta(minutes=i), "abc"[i % 3], float(i % 40)) for i in range(60)], "ts timestamp, phase string, duration_s double")
    folder = str(tmp_path / "spans")
    spans.write.parquet(folder)
    stream = jobs.phase_buckets(jobs.parquet_stream(spark, folder, spans.schema))
    stream.writeStream.format("memory").queryName("phase_buckets").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination(120)
    assert sorted(map(str, spark.table("phase_buckets").collect())) == sorted(map(str, jobs.phase_buckets(spans).collect()))


def test_pairing_reports_what_never_ended(spark):
    at = dt.datetime(2024, 1, 1)
    dispatched = spark.createDataFrame([(1, 0, at), (2, 0, at), (3, 0, at)], "task_id long, retry int, ts timestamp")
    finished = spark.createDataFrame([(1, 0, at + dt.timedelta(minutes=1)), (2, 1, at), (3, 0, at + dt.timedelta(hours=2))], "task_id long, retry int, ts timestamp")
    found = {r.task_id: r.finished_at is not None for r in jobs.paired(dispatched, finished).collect()}
    assert found == {1: True, 2: False, 3: False}


def test_streamed_pairs_and_what_is_still_open(spark, tmp_path):
    from gavel.operators.queries_streams import delivered

    start = dt.datetime(2024, 1, 1)
    at = lambda i: start + dt.timedelta(hours=i)
    begun = spark.createDataFrame([(i, 0, at(i)) for i in range(40)], "task_id long, retry int, ts timestamp")
    over = spark.createDataFrame([(i, i % 3 // 2, at(i) + dt.timedelta(minutes=200 if i % 7 == 0 else 5)) for i in range(40)], "task_id long, retry int, ts timestamp")
    part = F.floor(F.col("task_id") / 10)
    streams = [delivered(rows, part, F.col("task_id") % 2 == 0, str(tmp_path / name)) for name, rows in (("begun", begun), ("over", over))]
    jobs.append_stream(jobs.paired(*streams), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
    emitted = spark.read.parquet(str(tmp_path / "out"))
    assert emitted.filter("finished_at IS NULL").count() > 5 and emitted.count() == emitted.select("task_id").distinct().count() < 40
    found = {r.task_id: (r.finished_at is not None) for r in jobs.reconciled_pairs(emitted, begun, over).collect()}
    assert found == {i: i % 3 != 2 and i % 7 != 0 for i in range(40)}


def test_buckets_of_a_stream_tell_what_came_late(spark, tmp_path):
    from gavel.operators.queries_streams import delivered

    start = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(i, start + dt.timedelta(minutes=i), "a", 0.3) for i in range(120)], "event_id long, ts timestamp, phase string, duration_s double")
    lost = F.col("event_id") == 3  # comes with the last file only
    part = F.when(lost, 3).otherwise(F.floor(F.col("event_id") / 30))
    stream = delivered(rows, part, F.lit(False), str(tmp_path / "in"))
    jobs.append_stream(jobs.phase_buckets(stream), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
    found = jobs.reconciled_buckets(spark.read.parquet(str(tmp_path / "out")), rows).collect()
    assert sum(r.n + r.late for r in found) == 120 and [r.late for r in sorted(found, key=lambda r: r.window.start)][:2] == [1, 0]
