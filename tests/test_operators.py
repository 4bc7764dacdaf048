import datetime as dt

import pytest
from pyspark.sql import functions as F

from gavel.operators import graph, records, runs, search


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_related_edges_and_lineage(spark):
    catalog = spark.createDataFrame([(1, ["2", "x", None]), (2, ["1", "3"]), (3, ["99"]), (4, ["4"]), (5, None)], "id long, related_ids array<string>")
    edges = graph.related_edges(catalog)
    assert rows(edges) == [(1, 2, 1.0), (2, 3, 0.5), (4, 4, 1.0)]
    assert rows(graph.related_edges(catalog, mutual_only=True)) == [(1, 2, 1.0), (4, 4, 1.0)]
    assert rows(graph.components(catalog.select("id"), edges)) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5)]
    found = {r.catalog_id: (r.lineage_id, r.confidence) for r in graph.lineage(catalog.select("id"), edges).collect()}
    assert found == {1: ("lin-1", 0.7), 2: ("lin-1", 0.9), 3: ("lin-1", 0.7), 4: ("lin-4", 0.2), 5: ("lin-5", 0.2)}


def test_components_of_a_chain(spark):
    n = 60
    edges = spark.createDataFrame([(i + 1, i) for i in range(n)], "a long, b long")
    assert {r.component for r in graph.components(spark.range(n + 1), edges).collect()} == {0}


def test_nearest_neighbours_do_not_depend_on_blocks(spark):
    import numpy as np

    v = np.random.RandomState(0).randn(60, 8)
    df = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(60)], "id long, vector array<double>")
    assert rows(graph.nearest_neighbours(df, rows_per_block=7)) == rows(graph.nearest_neighbours(df, rows_per_block=1000))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    best = graph.vector_top_k(df, [float(x) for x in v[3]], 4).collect()
    assert [r.id for r in best] == list(np.argsort(-(unit @ unit[3]))[:4])


def test_page_rejects_bad_arguments(spark):
    with pytest.raises(ValueError):
        search.page(spark.range(1), "random")
    with pytest.raises(ValueError):
        search.page(spark.range(1), "newest", 0)


def test_trends_first_bucket_starts_with_its_quarter(spark):
    m = spark.createDataFrame([("a", "2024-01-05", ["Parks", "roll call"]), ("a", "2024-02-20", ["Parks"]), ("b", "2024-04-01", ["Parks"]), ("b", "2024-06-30", ["Parks"])], "city string, date string, topics array<string>")
    found = rows(search.trends_compare(m, ["a", "b"], "2024-02-01", "2024-05-31", "quarter").select("city", F.col("bucket").cast("string"), "topic", "n"))
    assert found == [("a", "2024-01-01", "Parks", 2), ("a", "2024-04-01", "Parks", 0), ("b", "2024-01-01", "Parks", 0), ("b", "2024-04-01", "Parks", 1)]


def test_candidates_and_fallback(spark):
    c = spark.createDataFrame([(1, "meeting", 7, 1, 0.5), (2, "meeting", 7, 2, 0.5), (3, "meeting", 7, 3, 0.9), (4, "agenda_item", 7, 4, 0.1)], "row_id long, result_type string, catalog_id long, db_id long, score double")
    assert rows(search.best_candidates(c).select("row_id")) == [(3,), (4,)]
    lexical = spark.createDataFrame([(7, 0), (8, 1), (8, 2)], "catalog_id long, rank long")
    found = search.with_lexical_fallback(c.filter("row_id = 3").select("catalog_id", "score"), lexical)
    assert [(r.catalog_id, r.score) for r in found.orderBy("place").collect()] == [(7, 0.9), (8, -2.0)]


def test_lexical_search_ranks_by_terms_then_field(spark):
    d = spark.createDataFrame([("a", "Budget hearing", ""), ("b", "", "budget hearing budget"), ("c", "budget", ""), ("d", None, None)], "id string, title string, content string")
    assert [r.id for r in search.lexical_search(d, "Budget hearing", ("title", "content")).collect()] == ["a", "b", "c"]


def test_promote_treats_null_dates_as_equal(spark):
    place = spark.createDataFrame([(1, "ocd-a")], "id long, ocd_division_id string")
    event = spark.createDataFrame([(1, 1, None, "Council")], "id long, place_id long, record_date date, name string")
    stage = spark.createDataFrame([(1, "ocd-a", None, "Council"), (2, "ocd-a", dt.date(2024, 1, 1), "Council"), (3, "ocd-a", dt.date(2024, 1, 1), "Council"), (4, "ocd-b", None, "Council")], "id long, ocd_division_id string, record_date date, name string")
    assert [r.outcome for r in records.promote(stage, event, place).orderBy("id").collect()] == ["duplicate", "promoted", "duplicate", "blocked"]


def test_budget_stops_at_the_first_overflow(spark):
    items = spark.createDataFrame([(1, 1, "aaaa"), (1, 2, "bbbbbbbb"), (1, 3, "c")], "catalog_id long, item_order long, title string")
    assert [r.item_order for r in records.character_budget(items, 6).collect()] == [1]


def test_metric_lines(spark):
    lines = spark.createDataFrame([('a_total{x="1",y="b"} 3',), ("# HELP a",), ("a_total 1e5",), ("plain 2.5",)], "value string")
    assert [(r.name, r.labels, r.value) for r in runs.metric_lines(lines).orderBy("name").collect()] == [("a_total", {"x": "1", "y": "b"}, 3.0), ("plain", {}, 2.5)]


def test_histogram_quantile_in_last_bucket(spark):
    spans = spark.createDataFrame([("p", 500.0), ("p", 0.05), ("p", 600.0)], "phase string, duration_s double")
    assert runs.histogram_quantile(runs.phase_histogram(spans), 0.9).first().value == 120.0


def test_counter_reset(spark):
    s = spark.createDataFrame([("k", 1, 5), ("k", 2, 9), ("k", 3, 2)], "k string, t int, v long")
    assert [(r.delta, r.reset_delta) for r in runs.counter_deltas(s, "k", "t", "v").orderBy("t").collect()] == [(None, 5), (4, 4), (None, 2)]


def test_agenda_items_are_all_lines_of_a_document(spark, tmp_path):
    import duckdb

    from gavel.plans.bridge import Tables, twin

    rows = [(1, "\n".join(f"line {i}" for i in range(1200))), (2, "only\nthese\n")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    found = {tuple(r) for r in Tables(spark, str(tmp_path)).agenda_item.collect()}
    assert len(found) == len({r[0] for r in found}) == 1203 and max(r[2] for r in found) == 1199
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert set(duck.execute(twin("SELECT * FROM {agenda_item}")).fetchall()) == found


def test_hydrate_numbers_only_the_page(spark):
    from gavel.operators import queries_merging

    found = queries_merging.QUERIES["g8_hydrate"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "GlobalLimit 31" in plan[plan.index("Window ") :]


def brute_ratio(a, b):
    a, b = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return 200.0 * row[-1] / (len(a) + len(b)) if a or b else 100.0


def test_title_ratio_and_greedy_groups(spark):
    import random

    from gavel.operators import matching

    rng = random.Random(3)
    words = ["budget", "budgets", "hearing", "zone", "zones", "park", "of", "the"]
    titles = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 5))) for _ in range(60)] + ["", None]
    for _ in range(200):
        a, b = rng.choice(titles[:-2]), rng.choice(titles[:-2])
        assert matching.token_sort_ratio(a, b) == pytest.approx(brute_ratio(a, b))
    items = spark.createDataFrame([(k, i, t) for k in (1, 2) for i, t in enumerate(titles if k == 1 else titles[::-1])], "catalog_id long, item_order long, title string")
    found = {(r.catalog_id, r.item_order): r.group_order for r in matching.near_titles(items).collect()}
    for k, own in ((1, titles), (2, titles[::-1])):
        heads = []
        for i, t in enumerate(own):
            if not t:
                assert (k, i) not in found
                continue
            head = next((h for h in heads if brute_ratio(t, own[h]) >= 92), None)
            if head is None:
                heads.append(i)
                head = i
            assert found[k, i] == head
    d = items.filter("catalog_id = 1").select("catalog_id", F.col("item_order").alias("item"), "title")
    best = {r["item"]: r["ratio"] for r in matching.best_titles(d.withColumn("title", F.concat("title", F.lit(" x"))), d, "catalog_id", 88).collect()}
    for i, t in enumerate(titles):
        top = max(brute_ratio(f"{t} x", u) for u in titles if u) if t else 0
        if t is None or top < 88:
            assert i not in best
        elif t:
            assert best[i] == pytest.approx(top)


@pytest.mark.parametrize("least", [85, 88, 92])
def test_no_similar_pair_is_missed(spark, least):
    import random

    from gavel.operators import matching

    rng = random.Random(least)
    titles = ["aaaaaaaa", "aaaaaaa", "abababab", "ababababa", "x", "xy", "éa", "aé"] + ["".join(rng.choice("ab c") for _ in range(rng.randint(1, 24))).strip() or "q" for _ in range(120)]
    for _ in range(150):
        t = list(rng.choice(titles))
        for _ in range(rng.randint(1, 3)):
            t.insert(rng.randint(0, len(t)), rng.choice("abz")) if rng.random() < 0.5 or len(t) < 2 else t.pop(rng.randrange(len(t)))
        titles.append("".join(t))
    # a document of 30 titles, and one of the rest
    rows = spark.createDataFrame([(int(i < 30), i, t) for i, t in enumerate(titles)], "k long, id long, title string")
    found = {(r.a, r.b): r.ratio for r in matching.similar_titles(rows, rows, "k", least, later=True).collect()}
    want = {(i, j): matching.ratio(titles[i], titles[j], 0) for i in range(len(titles)) for j in range(i + 1, len(titles)) if (i < 30) == (j < 30)}
    assert found == {p: pytest.approx(x) for p, x in want.items() if x >= least}


def test_bad_content_claims_and_answers(spark):
    from gavel.operators import titles

    d = spark.createDataFrame(
        [
            (1, "The system has encountered an error and could not complete your request. If the problem persists,\nplease contact the site administrator"),
            (2, "Agenda Report\nTo: all\nFrom: me\nSubject: x\nRecommendation: y\nAgenda number: 3"),
            (3, "Agenda Report\nTo: all\nFrom: me\nSubject: x\nRecommendation: y\nAgenda number: 3\nAdjournment"),
            (4, None),
        ],
        "id long, text string",
    )
    found = {r.id: r.reason for r in d.select("id", titles.bad_content(F.col("text"), category=F.lit("Agenda")).alias("reason")).collect()}
    assert found == {1: "laserfiche_error_page_detected", 2: "single_item_staff_report_detected", 3: None, 4: None}
    s = spark.createDataFrame([(1, "BLUF: none\n- The council approved roads\n* purple zebras dance", "Council approves the roads"), (2, "BLUF: council approved", "council approved"), (3, None, "x"), (4, "a claim here", None)], "id long, summary string, source string")
    g = {r.id: (r.claims, r.unsupported, r.coverage, r.grounded) for r in titles.grounding(s, "id", "summary", "source").collect()}
    assert g == {1: (2, 1, 0.5, False), 2: (1, 0, 1.0, True), 3: (0, 1, 0.0, False), 4: (1, 1, 0.0, False)}
    a = spark.createDataFrame([(1, "ITEM 1: Budget (page 4) - all of it\nitem 2: Parks - trees\nITEM 1: BUDGET (page 5)\nITEM 3:\n")], "id long, answer string")
    assert rows(titles.model_items(a, "id", "answer")) == [(1, 1, "Budget", 4, "all of it"), (1, 2, "Parks", 1, "trees")]


def test_registry_violations(spark):
    from gavel.sources import text_scans

    good = ("a", "wave1", "yes", "pass", "no", "", "", "", "")
    rows_ = [good, ("b", "wave3", "yes", "pass", "yes", "", "", "", ""), ("b", "", "no", "fail", "no", "r", "legistar_office_records", "Council", "2024-13-01"), ("C!", "", "no", "fail", "no", "", "", "Council", "")]
    d = spark.createDataFrame(rows_, ", ".join(f"{c} string" for c in text_scans.REGISTRY))
    found = rows(text_scans.registry_violations(d, spark.createDataFrame([("a",), ("b",)], "slug string")))
    assert found == [("C!", "incomplete_roster"), ("C!", "invalid_slug"), ("C!", "unknown_city"), ("b", "duplicate_slug"), ("b", "duplicate_slug"), ("b", "invalid_verified_at"), ("b", "invalid_wave"), ("b", "missing_noop_run")]
