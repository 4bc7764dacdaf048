"""Steps whose cost must not grow faster than their input, against plain computations of the same results."""

import re

import numpy as np
from pyspark.sql import functions as F

from gavel.functions import text
from gavel.operators import agenda_text, graph, postings, titles, topics


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def vectors(spark, x):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, vector array<float>")


def brute(x, k=3, least=0.35):
    x = x.astype(np.float32).astype(np.float64)
    x = x / np.maximum(1e-12, np.linalg.norm(x, axis=1, keepdims=True))
    found = {}
    for i in range(len(x)):
        s = np.round(np.einsum("ij,ij->i", np.repeat(x[i : i + 1], len(x), 0), x), 9)
        s[i] = -2
        best = np.lexsort((np.arange(len(x)), -s))[:k]
        found.update({(i, int(j)): s[j] for j in best if s[j] >= least})
    return found


def test_neighbours_of_copies_and_crowds(spark):
    rng = np.random.default_rng(5)
    crowd = rng.normal(size=8) + 0.01 * rng.normal(size=(150, 8))
    x = np.concatenate([rng.normal(size=(60, 8)), np.repeat(rng.normal(size=(1, 8)), 40, 0), crowd, np.zeros((2, 8))])
    for rows_per_block in (37, 1000):
        found = {(r.id, r.neighbour): r.score for r in graph.nearest_neighbours(vectors(spark, x), rows_per_block=rows_per_block).collect()}
        assert found == brute(x)


def test_blocks_of_vectors_are_not_shuffled(spark):
    d = graph.nearest_neighbours(vectors(spark, np.eye(8)), rows_per_block=2)
    below = plan(d).split("MapInArrow", 1)[1]
    assert "Exchange hashpartitioning" not in below


def test_approximate_search_shuffles_a_vector_a_bounded_number_of_times(spark, monkeypatch):
    x = np.random.default_rng(6).normal(size=(1600, 16))  # no clusters: most of the 40 lists are needed
    steps, write = [], graph.checkpointed
    monkeypatch.setattr(graph, "checkpointed", lambda df: steps.append(write(df)) or steps[-1])
    found = {(r.id, r.neighbour) for r in graph.approximate_neighbours(vectors(spark, x)).collect()}
    assert max(s.agg(F.max(F.size("lists"))).first()[0] for s in steps if "lists" in s.columns) <= 16
    exact = set(brute(x))
    assert len(found & exact) >= 0.9 * len(exact)


def packed(t, most, scan, pieces):
    done, now = [], ""
    for w in " ".join(t.split())[: most * scan].split(" "):
        if now and w and len(now) + 1 + len(w) > most:
            done, now = [*done, now], w
        elif w:
            now = f"{now} {w}" if now else w
    return ([*done, now] if now else done)[:pieces]


def test_chunks_are_cut_at_once(spark):
    texts = ["a" * 9 + " b c  d", "aaaa bbb cc dddddddd e " * 3, "\t x\n\ny ", "", "12345678 1234567 1 12345678", "ab " * 40, "é😀 ü😀😀😀😀😀😀 x", "abc defg hij klmn opq rst uvw xyz"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = d.select("i", agenda_text.chunks(F.col("t"), 8, 3, 5).alias("c"))
    assert {r.i: r.c for r in found.collect()} == {i: packed(t, 8, 3, 5) for i, t in enumerate(texts)}
    # words are not put together one by one, which copies a piece for each of its words
    assert "aggregate(" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_words_are_counted_in_their_row(spark):
    d = spark.createDataFrame([(0, ["b", "a", "b", "é", ""]), (1, []), (2, ["x"])], "i int, w array<string>")
    found = {r.i: [(x.value, x.n) for x in r.c] for r in d.select("i", text.counted(F.col("w")).alias("c")).collect()}
    assert found == {0: [("", 1), ("a", 1), ("b", 2), ("é", 1)], 1: [], 2: [("x", 1)]}


DOCS = [(1, "the park zoning park zoning board"), (2, "Budget budget x-ray zoning"), (3, None), (4, ""), (5, "alone"), (6, "tree tree park")]


def test_a_documents_phrases_are_not_shuffled(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    found = titles.small_corpus_keywords(docs, ("the",))
    assert "Exchange" not in plan(found)
    assert [(r.phrase, r.rank) for r in found.filter("doc_id = 1").orderBy("rank").collect()] == [("park zoning", 1), ("park zoning board", 2), ("park zoning park", 3), ("zoning board", 4), ("zoning park", 5)]
    split = docs.filter("doc_id IN (1, 6)").withColumn("doc_id", F.lit(1).cast("long"))  # a key's texts count together, no phrase runs over their ends
    assert [(r.phrase, r.rank) for r in titles.small_corpus_keywords(split, ("the",), most=2).orderBy("rank").collect()] == [("park zoning", 1), ("park zoning board", 2)]


def test_tfidf_shuffles_no_row_for_each_document_and_term_but_of_the_vocabulary(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    found = topics.keywords(docs)
    assert not re.search(r"hashpartitioning\(doc_id#\d+L?, term", plan(found))
    assert found.count() and {r.doc_id for r in found.collect()} == {1, 2, 5, 6}


def test_an_index_shuffles_no_words(spark, monkeypatch, tmp_path):
    from pyspark.sql.readwriter import DataFrameWriter

    plans, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **k: plans.append((path, plan(self._df))) or write(self, path, *a, **k))
    documents = spark.createDataFrame([("a", "Park board"), ("b", "Park board"), ("c", None)], "id string, event_name string")
    names = documents.select(F.col("event_name").alias("unit"), F.col("event_name").alias("text")).filter("unit IS NOT NULL").distinct()
    postings.build(documents, [postings.Field("event_name", "event_name", names)], str(tmp_path / "i"))
    written = next(p for path, p in plans if path.endswith("/postings"))
    assert "Exchange" not in written.split("Generate", 1)[0]  # what is above the words
    (size,) = spark.read.parquet(str(tmp_path / "i/fields")).collect()
    assert (size.words, size.units, size.docs) == (4, 1, 3)


def test_rows_look_no_lower_than_their_own_block(spark):
    """A block carries its rows' floors, so that blocks that meet it need not find its neighbours anew."""
    x = np.random.default_rng(8).normal(size=(90, 6))
    rows = vectors(spark, x).withColumn("key", F.col("id") % 2).groupBy("key").agg(F.collect_list(F.struct("id", "vector")).alias("rows"))
    for r in graph._packed(rows, 3, 0.35).collect():
        ids, floor = np.frombuffer(r["rows"].ids, np.int64), np.frombuffer(r["rows"].floor, np.float64)
        own = brute(x[ids])
        for i in range(len(ids)):
            best = sorted((s for (a, _), s in own.items() if a == i), reverse=True)
            assert floor[i] == (best[2] if len(best) > 2 else -np.inf)
    flags = np.random.default_rng(9).random((48, 64)) < 0.02
    assert all((a == b).all() for a, b in zip(graph._places(flags), np.nonzero(flags)))


def test_vocabulary_is_that_of_all_sums_without_shuffling_rare_terms(spark, monkeypatch):
    rows = [(d, f"w{t % (7 + d % 50)}", 1 + (d * t) % 3) for d in range(300) for t in range(40)] + [(d, f"rare{d}", 1) for d in range(300)]
    tf = spark.createDataFrame(rows, "key long, term string, tf long").groupBy("key", "term").agg(F.sum("tf").alias("tf"))
    sums = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).collect()
    for features in (5, 20, 10_000):
        wanted = sorted((r for r in sums if r.df <= 0.8 * 300), key=lambda r: (-r.total, r.term))[:features]
        found = topics._commonest(tf, 300, 0.8, features)
        assert [(r.term, r.df, r.total) for r in found.collect()] == [(r.term, r.df, r.total) for r in wanted]
        assert features == 5 or ("bucket" in plan(found)) == (features == 20)
