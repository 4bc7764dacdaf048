"""Versioned tables, the stored index, components, neighbours and exact ranks against plain versions."""

import datetime as dt
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gavel.operators import changes, graph, postings, runs
from gavel.operators.search import SearchFilters
from gavel.plans import tables


def versioned(spark):
    return tables.Versioned(spark, tables.new_folder(spark, "test"))


def test_a_batch_is_applied_once(spark):
    table, rows = versioned(spark), lambda n: spark.range(n).withColumn("k", F.col("id") % 2)
    assert table.apply("one", lambda old: rows(3)) and table.apply("two", lambda old: old.union(rows(2)))
    assert not table.apply("one", lambda old: old.union(rows(100))) and table.read().count() == 5
    assert table.batches() == ["one", "two"] and table.read(0).count() == 3
    with pytest.raises(ValueError):
        table.apply("a/b", lambda old: old)
    with pytest.raises(ZeroDivisionError):
        table.apply("three", lambda old: old.limit(1 // 0))
    rows(9).write.parquet(f"{table.folder}/_left-by-a-dead-writer")
    assert table.read().count() == 5
    table.apply("three", lambda old: old.limit(1), partition_by=("k",))
    table.expire(1)
    empty = versioned(spark)
    empty.apply("none", lambda old: rows(0), partition_by=("k",))
    assert empty.read().columns == ["id", "k"] and empty.read().count() == 0
    assert table.batches() == ["one", "two", "three"] and table.read().count() == 1 and not table.apply("two", lambda old: old)


def test_upserts_replace_and_keep(spark):
    table = versioned(spark)
    first = spark.createDataFrame([("a", "meeting", 1), ("b", "agenda_item", 2)], "id string, result_type string, v long")
    again = spark.createDataFrame([("b", "agenda_item", 3), ("c", "meeting", 4)], "id string, result_type string, v long")
    changes.write_search_documents(table, first, "first")
    changes.write_search_documents(table, again, "second", spark.createDataFrame([("a",), ("zz",)], "id string"))
    changes.write_search_documents(table, first, "first")
    assert sorted((r.id, r.v) for r in table.read().collect()) == [("b", 3), ("c", 4)]


# the index

WORDS = ["park", "Budget", "the", "naïve", "o'neil", "x9", "zoning", "tree"]


def bm25(rows, fields, terms):
    """id -> (matched, first field, score), from the texts."""
    cut = lambda text: re.findall(r"(?:[^\W_]|')+", (text or "").lower())
    out = {}
    for n, f in enumerate(fields):
        docs = [(r["id"], Counter(cut(r[f])), len(cut(r[f]))) for r in rows]
        mean = sum(length for _, _, length in docs) / max(1, len(docs))
        for t in terms:
            df = sum(t in c for _, c, _ in docs)
            for i, c, length in docs:
                if t in c:
                    s = math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * length / mean))
                    matched, first, score = out.get(i, (set(), n, 0.0))
                    out[i] = (matched | {t}, first, score + s)
    return {i: (len(m), f, s) for i, (m, f, s) in out.items()}


@pytest.fixture(scope="module")
def indexed(spark):
    rng = random.Random(3)
    contents = {c: None if c % 9 == 0 else " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 120))) for c in range(30)}
    rows = [{"id": f"d{i:03d}", "result_type": "meeting" if i % 4 else "agenda_item", "city": rng.choice("AB"), "organization": "o", "meeting_category": "Regular", "date": rng.choice([None, "2024-01-05", "2024-03-01", "2024-02-02"]), "catalog_id": c, "event_name": rng.choice(["park the day", "zoning", None]), "content": contents[c]} for i, c in ((i, rng.randrange(30)) for i in range(150))]
    schema = "id string, result_type string, city string, organization string, meeting_category string, date string, catalog_id long, event_name string"
    documents = spark.createDataFrame([{k: v for k, v in r.items() if k != "content"} for r in rows], schema)
    texts = spark.createDataFrame(list(contents.items()), "unit long, text string")
    names = documents.select(F.col("event_name").alias("unit"), F.col("event_name").alias("text")).distinct()
    path = tables.new_folder(spark, "index")
    postings.build(documents, [postings.Field("event_name", "event_name", names), postings.Field("content", "catalog_id", texts)], path, "content")
    return path, rows


@pytest.mark.parametrize("query", ["park", "The budget o'neil", "NAÏVE zoning nowhere", "nowhere", "", "!!"])
@pytest.mark.parametrize("sort", ["relevance", "newest", "oldest"])
def test_search_equals_a_scan(spark, indexed, query, sort):
    path, rows = indexed
    found = bm25(rows, ["event_name", "content"], postings.terms_of(query))
    asked = SearchFilters(city="A", date_from=dt.date(2024, 1, 2), include_agenda_items=True) if sort == "newest" else None
    kept = [r for r in rows if r["id"] in found and (asked is None or (r["city"] == "A" and (r["date"] or "") >= "2024-01-02"))]
    by = {"relevance": lambda r: (-found[r["id"]][0], found[r["id"]][1], -round(found[r["id"]][2], 6), r["id"])}
    by["newest"] = lambda r: (r["date"] is None, [-ord(c) for c in r["date"] or ""], r["id"])
    by["oldest"] = lambda r: (r["date"] is None, r["date"] or "", r["id"])
    want = [(r["id"], found[r["id"]][0], found[r["id"]][1], pytest.approx(found[r["id"]][2], abs=2e-6)) for r in sorted(kept, key=by[sort])][3:13]
    got = postings.search(spark, path, query, asked, sort, 10, 3).collect()
    assert [(r.id, r.matched, r.field_rank, r.score) for r in got] == want


def test_search_reads_only_its_buckets_and_tokenises_nothing(spark, indexed):
    plan = postings.search(spark, indexed[0], "park zoning")._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan and "bucket#" in plan and re.search(r"PartitionFilters: \[bucket", plan)


def test_snippets_show_the_first_match(spark, indexed):
    page = postings.search(spark, indexed[0], "zoning", limit=100)
    text = {r["id"]: r["content"] for r in indexed[1]}
    for r in postings.highlighted(page, indexed[0], "zoning", 1, crop=6, pre="[", post="]").collect():
        words = (text[r.id] or "").split()
        begin = max(0, (words.index("zoning") if "zoning" in words else 0) - 3)
        assert (r.snippet or "") == " ".join(f"[{w}]" if w == "zoning" else w for w in words[begin : begin + 6])
    with pytest.raises(ValueError):
        postings.search(spark, indexed[0], "zoning", limit=101)


def test_an_empty_index(spark, indexed):
    empty = spark.read.parquet(f"{indexed[0]}/documents").drop("_unit0", "_unit1").limit(0)
    path = tables.new_folder(spark, "index")
    postings.build(empty, [postings.Field("event_name", "event_name", empty.select(F.col("event_name").alias("unit"), F.col("event_name").alias("text")))], path)
    assert postings.search(spark, path, "park").count() == 0


# components


def united(nodes, edges):
    top = {n: n for n in nodes}

    def find(x):
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("shape", ["random", "star", "chain", "none"])
def test_components_equal_union_find(spark, shape):
    rng = random.Random(shape)
    n = 300
    edges = {"random": [(rng.randrange(n), rng.randrange(n)) for _ in range(220)], "star": [(299, i) for i in range(290)], "chain": [(i, i + 1) for i in range(250)], "none": [(3, 3)]}[shape]
    found = graph.components(spark.range(n), spark.createDataFrame(edges, "a long, b long"), least=20)
    assert {r.id: r.component for r in found.collect()} == united(range(n), edges)


def test_hot_keys_are_dealt(spark):
    left = tables.checkpointed(spark.range(1000).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("v")))
    right = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    hot = tables.hot_keys(left, "k", 100)
    assert [tuple(r) for r in hot.collect()] == [(7, 6)]
    for how in ("inner", "left"):
        same = tables.spread_join(left, right, "k", "v", hot, how)
        assert sorted(map(tuple, same.select("k", "v", "w").collect())) == sorted(map(tuple, left.join(right, "k", how).select("k", "v", "w").collect()))


# neighbours


@pytest.mark.parametrize("clusters", [0, 40])
def test_approximate_neighbours_find_most_of_the_exact(spark, clusters):
    rng = np.random.RandomState(clusters)
    centre = rng.normal(size=(max(1, clusters), 24))
    x = rng.normal(size=(900, 24)) if not clusters else centre[rng.randint(clusters, size=900)] + rng.normal(size=(900, 24)) * 0.3
    x[5] = x[6]
    x[7] = 0
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    exact = {(r.id, r.neighbour): r.score for r in graph.nearest_neighbours(vectors).collect()}
    found = {(r.id, r.neighbour): r.score for r in graph.approximate_neighbours(vectors, rows_per_block=50).collect()}
    assert len(exact.keys() & found.keys()) >= 0.9 * len(exact)
    assert all(abs(exact[p] - found[p]) < 1e-9 for p in exact.keys() & found.keys())
    assert max(Counter(i for i, _ in found).values()) <= 3
    assert graph.approximate_neighbours(vectors.limit(0)).count() == 0


# ranks


def test_ranks_are_exact(spark):
    rng = random.Random(1)
    rows = [(rng.choice("AAAAAAB"), rng.choice([None, 0.0, 1.5, rng.random() * 9])) for _ in range(3000)] + [("C", 4.0), ("D", None)]
    found = runs.at_ranks(spark.createDataFrame(rows, "arm string, v double"), "arm", "v", {"p95": F.ceil(F.col("n") * 0.95), "low": F.floor((F.col("n") + 1) / 2)})
    want = {}
    for arm in "ABC":
        v = sorted(x for a, x in rows if a == arm and x is not None)
        want[arm] = (v[math.ceil(len(v) * 0.95) - 1], v[(len(v) + 1) // 2 - 1])
    assert {r.arm: (r.p95, r.low) for r in found.collect()} == want


def test_search_sink_keeps_each_content_once(spark):
    from gavel.operators import changes

    sink = tables.Versioned(spark, tables.new_folder(spark, "sink"))
    rows = lambda n, by: spark.createDataFrame([(f"d{i}", "meeting", None if i == 3 else f"{by}{i % 2}", i) for i in range(n)], "id string, result_type string, content string, n int")
    assert changes.write_search_documents(sink, rows(6, "a"), "full")
    gone = spark.createDataFrame([("d5",)], "id string")
    assert changes.write_search_documents(sink, rows(2, "b"), "amended", gone) and not changes.write_search_documents(sink, rows(6, "a"), "full")
    assert "content" not in sink.read().columns
    assert sorted(map(tuple, changes._texts(sink).read().select("content").collect())) == [("a0",), ("a1",), ("b0",), ("b1",)]
    found = {r.id: (r.content, r.n) for r in changes.search_documents(sink).collect()}
    assert found == {"d0": ("b0", 0), "d1": ("b1", 1), "d2": ("a0", 2), "d3": (None, 3), "d4": ("a0", 4)}
