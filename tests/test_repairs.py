"""Repair of links on small cases."""

from gavel.operators import repairs


def test_verdicts_and_tables(spark):
    catalog = spark.createDataFrame([(1, "u1", "h1", "text", 2), (2, "u2", "h2", "text", 2), (3, "u3", None, None, None), (4, "u4", "h4", "t", 1), (5, "u5", "h4", "t", 1)], "id long, url string, url_hash string, content string, extraction_attempt_count int")
    asked = [(1, 1, "h2"), (2, 2, "new"), (3, 3, "new"), (4, 9, "x"), (5, 9, "h1"), (6, 4, "h4"), (7, 3, "h9"), (8, 3, "h10"), (9, 1, "h1")]
    r = spark.createDataFrame([(s, c, f"url-{h}", h, f"files/{h}", h) for s, c, h in asked], "seq int, catalog_id long, new_url string, new_hash string, path string, filename string")
    verdicts = repairs.repair_verdicts(catalog, r)
    got = {x.seq: x.outcome for x in verdicts.collect()}
    dup, done = "skipped_duplicate_hash", "updated"
    # 1: another's; 3: the second to ask; 4: no such catalog; 5: taken, whoever asks; 6: a second catalog has it too; 9: its own
    assert {k: got[k] for k in (1, 2, 4, 5, 6, 9)} == {1: dup, 2: done, 4: "no_catalog", 5: dup, 6: dup, 9: done}
    documents = spark.createDataFrame([(1, 2, "agenda", "u2"), (2, 2, "minutes", "u2"), (3, 4, "agenda", "u4"), (4, None, None, None)], "id long, catalog_id long, category string, url string").selectExpr("*", "url AS url_hash")
    embeddings = spark.createDataFrame([(2, 1), (4, 2), (None, 3)], "catalog_id long, vec int")
    c, d, e = repairs.apply_repairs(catalog, documents, embeddings, verdicts.filter("seq IN (1, 2)"))
    assert {x.id: (x.url, x.content, x.extraction_attempt_count) for x in c.collect()} == {1: ("u1", "text", 2), 2: ("url-new", None, 0), 3: ("u3", None, None), 4: ("u4", "t", 1), 5: ("u5", "t", 1)}
    assert {x.id: x.url for x in d.collect()} == {1: "url-new", 2: "u2", 3: "u4", 4: None} and d.columns == documents.columns
    assert sorted(x.vec for x in e.collect()) == [2, 3]


def test_nothing_to_repair(spark):
    catalog = spark.createDataFrame([(1, "h1")], "id long, url_hash string")
    none = spark.createDataFrame([], "seq int, catalog_id long, new_url string, new_hash string, path string, filename string")
    assert repairs.repair_verdicts(catalog, none).count() == 0
    one = spark.createDataFrame([(1, 1, "u", "h", "p", "f"), (2, None, "u", None, "p", "f")], none.schema)
    assert {x.seq: x.outcome for x in repairs.repair_verdicts(catalog.limit(0), one).collect()} == {1: "no_catalog", 2: "no_catalog"}
