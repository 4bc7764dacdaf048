"""A sink's batches write only what is new, and what is made of a content is made once."""

from pyspark.sql import functions as F

from gavel.operators import changes
from gavel.plans import tables


def test_a_batch_writes_no_content_again(spark):
    sink = tables.Versioned(spark, tables.new_folder(spark, "sink"))
    rows = spark.createDataFrame([(f"d{i}", "meeting", None if i % 4 == 3 else f"c{i % 4}") for i in range(40)], "id string, result_type string, content string")
    changes.write_search_documents(sink, rows, "full")
    changes.write_search_documents(sink, rows.filter("id < 'd3'"), "again", spark.createDataFrame([("d1",), ("d9",)], "id string"))
    new = tables.Versioned(spark, f"{sink.folder}/_contents")
    assert [new.read(n).count() for n in range(2)] == [3, 0]
    found = changes.search_documents(sink, F.upper)
    assert {r.id: r.content for r in found.collect()} == {f"d{i}": None if i % 4 == 3 else f"C{i % 4}" for i in range(40) if i not in (1, 9)}
    # rows without a content do not meet in one task of a join
    assert "Union" in found._jdf.queryExecution().optimizedPlan().toString()
