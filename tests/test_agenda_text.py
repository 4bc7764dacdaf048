from pyspark.sql import functions as F

from gavel.operators import agenda_text


def test_roll_calls(spark):
    df = spark.createDataFrame([(1, "Motion carried. Ayes: Arreguin, Bartlett and Wei. Noes: None. Absent: Kim, 3"), (2, None), (3, "no vote")], "id long, text string")
    assert sorted(map(tuple, agenda_text.roll_calls(df, "id", "text").collect())) == [(1, "absent", "Kim"), (1, "ayes", "Arreguin"), (1, "ayes", "Bartlett"), (1, "ayes", "Wei")]
    assert [r[0] for r in df.select(agenda_text.roll_call_result(F.col("text"))).collect()] == ["carried", None, None]


def test_chunks(spark):
    text = "aa bb cccccccc d e " * 3
    found = spark.createDataFrame([(text,), (None,), ("  ",)], "t string").select(agenda_text.chunks(F.col("t"), 8, 3, 5)).collect()
    assert found[0][0] == ["aa bb", "cccccccc", "d e aa", "bb"] and found[1][0] == [] and found[2][0] == []


def test_html_lines_and_numbered_rows(spark):
    html = "<script>x</script ><div>1. Call &amp; order now</div><p>B) call &amp; ORDER NOW<br>II: Budget hearing<li>plain"
    lines = spark.createDataFrame([(1, html)], "page_id long, html string").select("page_id", F.posexplode(agenda_text.html_lines(F.col("html"))).alias("line_no", "line"))
    assert [tuple(r) for r in agenda_text.numbered_rows(lines).orderBy("item_order").collect()] == [(1, 1, "1", "Call & order now"), (1, 2, "II", "Budget hearing")]
