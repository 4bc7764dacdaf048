"""Summaries made plain: literal cases, and texts of any length."""

from pyspark.sql import functions as F

from gavel.operators import bluf


def normalized(spark, *pairs):
    d = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, summary string, source string")
    return [r.normalized for r in bluf.bluf_summaries(d).orderBy("i").collect()]


def test_introductions_emphasis_and_attendance_go(spark):
    raw = "Here's a summary of the meeting minutes:\n* **Agenda:** Teleconference meeting via Zoom (register in advance)\n* **Action:** Approved a budget amendment.\n* **Vote:** All Ayes.\n"
    calls = "BLUF: Committee discussed agenda items.\n- Join by phone: (510) 555-1234\n- Meeting ID 123 456 789\n- Budget amendment approved.\n- Public safety update received.\n"
    got = normalized(spark, (raw, "Budget amendment. Vote: All Ayes."), (calls, "Budget amendment approved. Public safety update received."))
    assert got[0] == "BLUF: Action: Approved a budget amendment.\n- Action: Approved a budget amendment.\n- Vote: All Ayes."
    assert got[1] == "BLUF: Committee discussed agenda items.\n- Budget amendment approved.\n- Public safety update received."


def test_limits_and_fallbacks(spark):
    many = "\n".join(["BLUF: Main takeaway."] + [f"- Detail {i}." for i in range(1, 20)])
    long = "BLUF: " + " ".join(f"w{i}" for i in range(40)) + "\n- held fact"
    got = normalized(
        spark, (many, "Some details text."), (many, None), (long, "held fact"), (None, "x"), ("", "x"), ("Here is the summary", "[PAGE 3] Roads  are\nfixed"), ("  \n ", ""), ("BLUF: Zeppelins", "Roads are fixed. 2. Water is clean again 3. short 4. WATER IS CLEAN AGAIN"), ("BLUF: Zeppelins", "few"), ("BLUF: Dial in.\nBLUF: last wins! And more", "tiny"), ("One.\nTwo unsupported zeppelin\nThree", "one three")
    )
    assert got[0].splitlines() == ["BLUF: Main takeaway.", *(f"- Detail {i}." for i in range(1, 8))]
    assert got[1] == got[0]
    assert got[2] == "BLUF: " + " ".join(f"w{i}" for i in range(30)) + ".\n- held fact"
    assert got[3:5] == [None, ""]
    assert got[5] == "BLUF: Summary unavailable from extracted text.\n- Roads are fixed"
    assert got[6] == "BLUF: Summary unavailable from extracted text.\n- Summary unavailable."
    assert got[7] == "BLUF: Zeppelins.\n- Roads are fixed.\n- Water is clean again"
    assert got[8] == "BLUF: Zeppelins.\n- few"
    assert got[9] == "BLUF: last wins!\n- tiny"
    assert got[10] == "BLUF: One.\n- One.\n- Three"


def test_a_line_that_failed_among_the_first_takes_a_place_when_topping_up(spark):
    lines = "\n".join(["BLUF: x.", *(f"- zeppelin number {i}" for i in "abcdefg"), "- alpha beta"])
    # three of the seven that the source does not hold come first and fail again, so nothing is left but the source
    assert normalized(spark, (lines, "alpha beta gamma delta")) == ["BLUF: x.\n- alpha beta gamma delta"]


def test_long_and_clashing(spark):
    source = "alpha beta " * 200_000
    d = spark.createDataFrame([(source, "BLUF: a.\n" + "\n".join(f"- alpha line {i}" for i in range(3000)), 1)], "source string, summary string, lines int")
    row = bluf.bluf_summaries(d).first()
    assert row.normalized.splitlines() == ["BLUF: a.", *(f"- alpha line {i}" for i in range(7))] and row.lines == 1
    assert bluf.bluf_summaries(d.limit(0)).count() == 0


def test_acknowledgements(spark):
    said = ["Okay, sure.\n\nI will help.\nText\n\nmore ", "\nUnderstood\nThe BLUF: all is well \n\n- x\n", "Got it", None, "BLUF: a", "I'll do\nFine. BLUF later\nbluf: z"]
    d = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string")
    got = [r[0] for r in d.orderBy("i").select(bluf.without_acknowledgement(F.col("s"))).collect()]
    assert got == ["Text\n\nmore", "BLUF: all is well\n- x", "", "", "BLUF: a", "Fine. BLUF later\nbluf: z"]
