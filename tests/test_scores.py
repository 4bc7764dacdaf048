"""Scores, repair, summaries and evidence on small cases, the repair against a direct reading."""

import itertools
import random
import re

from pyspark.sql import functions as F

from gavel.operators import evidence, repair, scores, summaries


def column(spark, values, c, **more):
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in d.orderBy("i").select(c(F.col("v"))).collect()]


def test_human_names(spark):
    names = {"Maria Lopez": True, "maria lopez": True, "maria de lopez": False, "J A N E D": False, "City of Ana": False, "Ana": False, "Jo Ann 2": False, "Doe v. Roe": False, "Brrrght Krshnttw": False, "A B C D E": False, "The Smith": False, "Ana Paz.": False, None: False, "  ": False}
    assert column(spark, list(names), scores.is_human_name) == list(names.values())
    assert column(spark, ["Ana", "clerk", None], lambda c: scores.is_human_name(c, True)) == [True, True, False]


def test_quality_of_no_titles_and_repeats(spark):
    rows = [(1, None, None), (1, " ", None), (1, "", 1), (2, "Contract for roads", 2), (2, "contract  for Roads", 3), (3, "Contract for roads", 2)]
    d = spark.createDataFrame([(c, t, None, None, p) for c, t, p in rows], "catalog_id long, title string, description string, result string, page_number int")
    got = {r.catalog_id: (r["items"], r.score, r.low) for r in scores.quality_scores(d, "catalog_id").collect()}
    # 3 blanks: 75, first page 20, repeats 10; 2: one repeat 15
    assert got == {1: (3, 0, True), 2: (2, 85, False), 3: (1, 100, False)}


def test_flat_titles_and_candidates(spark):
    text = "x 1. Hearing on water fees 2. Join by phone today 3. HEARING ON WATER FEES 4. Sale of the old mill"
    assert column(spark, [text, None, ""], scores.flat_titles) == [["Hearing on water fees", "Sale of the old mill"], [], []]
    assert column(spark, ["1. Short\n2. Approve the budget\n 3. Repair the long bridge"], scores.flat_titles)[0] == ["Approve the budget", "Repair the long bridge"]
    lines = "Mayor one\nnothing\n" + "Chair " + "x" * 30 + "\nAyes: all"
    got = column(spark, [lines, "none", None], lambda c: scores.entity_candidates(c, F.lit("Agenda"), agenda=20, prefix=3))
    assert [tuple(g) for g in got] == [("Mayor one", False, False), ("non", True, True), ("", True, False)]
    assert column(spark, ["Chair " + "x" * 30], lambda c: scores.entity_candidates(c, F.lit("agenda"), agenda=20))[0].text == "Chair " + "x" * 14


def brute_words(letters):
    """The split of least cost over all splits; of equal ones that with the longest last word, then the one before it."""
    ways = []
    for cuts in itertools.chain.from_iterable(itertools.combinations(range(1, len(letters)), k) for k in range(len(letters))):
        at = [0, *cuts, len(letters)]
        parts = [letters[a:b] for a, b in zip(at, at[1:])]
        cost = sum(1 if p in repair.LEXICON else 20 if len(p) == 1 else 10 + len(p) for p in parts)
        ways.append((cost, [-len(p) for p in reversed(parts)], parts))
    return min(ways)[2]


def test_least_cost_words():
    rng = random.Random(5)
    pieces = ["THE", "CITY", "OF", "X", "QZ", "A", "IN", "ITEM"]
    for _ in range(60):
        letters = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 4)))[:11]
        assert repair.cheapest_words(letters) == brute_words(letters)


def brute_join(text):
    def join(m):
        parts = re.split(r"(\s+)", m.group(0))
        return "".join(p if i % 2 == 0 else " " if len(p) > 1 or "\n" in p else "" for i, p in enumerate(parts))

    return re.sub(r"\b(?:[A-Z]\s+){2,}[A-Z]\b", join, text)


def test_joined_capitals(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice(["A", "B", "CD", " ", " ", "  ", "\n", "x", "-", "é"]) for _ in range(30)) for _ in range(300)] + ["", "A B CD", "A B C DE", "A B C", "A " * 20000 + "B"]
    assert column(spark, texts, repair.joined_capitals) == [brute_join(t) for t in texts]
    assert column(spark, [None], repair.joined_capitals) == [""]


def test_repaired_text(spark):
    texts = ["ANN OT ATE D AG EN DA SPE CI AL\n\n\n\n\nplain  \nend", "AN NO TA TE D AG EN DA 510-555-1234", None, "  "]
    d = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "id int, text string, _line string")
    got = {r.id: (r.repaired, r._line) for r in repair.repair_text(d).collect()}
    assert got == {0: ("ANNOTATED AGENDA SPECIAL\n\n\nplain\nend", "kept"), 1: (texts[1], "kept"), 2: ("", "kept"), 3: ("", "kept")}
    assert column(spark, ["see https://a.b/c www.d or HTTP [page 2] x"], repair.topic_text)[0].split() == ["see", "or", "x"]


def test_reextraction(spark):
    catalog = spark.createDataFrame([(1, "old text", "a", 0), (2, "old", "a", 1), (3, "old", "placeholder", 2), (4, "old", "a", None), (5, None, "a", 0)], "catalog_id long, content string, location string, attempts int")
    new = spark.createDataFrame([(1, "x"), (2, " fresh text "), (3, "y"), (5, "")], "catalog_id long, text string")
    got = {r.catalog_id: (r.outcome, r.content, r.state, r.attempts, r.error) for r in repair.reextracted(catalog, new, 5).collect()}
    assert got == {
        1: ("cached", "old text", "complete", 0, None),
        2: ("updated", "fresh text", "complete", 0, None),
        3: ("failed", "old", "failed_terminal", 3, "Catalog has no file location"),
        4: ("failed", "old", "failed", 1, "File not found on disk"),
        5: ("failed", None, "failed", 1, "Extraction returned empty text"),
    }


def test_summary_of_one_and_of_noise(spark):
    items = spark.createDataFrame([(1, 0, "Approve the contract of $5 million", "with the builders of the bridge", "Passed", 3), (2, 0, "Join the webinar", None, None, 1)], "catalog_id long, item_order long, title string, description string, result string, page_number long")
    catalog = spark.createDataFrame([(1, None, None), (2, None, None), (3, "empty", None), (4, None, "bad")], "catalog_id long, segmentation string, bad string")
    got = {r.catalog_id: (r.status, r.summary, r.error) for r in summaries.agenda_summaries(catalog, items).collect()}
    assert got[1][0] == "complete" and got[1][1].splitlines()[0] == "BLUF: Agenda includes 1 substantive item. Mentioned monetary figures include $5 million."
    assert "Decision/action requested:\n- Approve the contract of $5 million (p.3): with the builders of the bridge\n" in got[1][1] and got[1][1].endswith("Unknowns:\n- " + summaries.UNKNOWN_REST)
    assert got[2] == ("blocked_low_signal", None, None) and got[3] == ("complete", summaries.EMPTY_AGENDA, None) and got[4] == ("error", None, "bad")


def test_evidence_without_events(spark):
    none = spark.createDataFrame([], "run_id long, seq long, event_type string, task_id string, retry int, boundary string, execution_id string, outcome string")
    assert evidence.task_reasons(none).count() == 0
    phases = spark.createDataFrame([], "run_id long, event_type string, phase string, subject string, boundary string, eligible_count int, ids array<long>, outcome string")
    got = {r.reason for r in evidence.phase_reasons(phases, spark.range(1).withColumnRenamed("id", "run_id")).collect()}
    assert got == {*(f"phase_eligibility_incomplete:{p}:catalog" for p, _ in evidence.ELIGIBILITY), *(f"phase_span_incomplete:{p}" for p in evidence.SPANS), "initial_workload_missing"}
