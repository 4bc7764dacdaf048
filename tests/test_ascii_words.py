"""Words, upper case and ends of texts are as the twins' SQL has them, also beside letters beyond ASCII."""

import duckdb
import pytest

from gavel import registry
from gavel.functions.text import SEVERAL, ascii_bounds

TEXTS = [
    "Die ungeß motionä vote: 5\nach über\xfcada x\nöee tel: 5\nFor 510-555-1234ö\nachpageö 3\nÜtableß ende\nein\nein\n\nein ordinanceß über",
    "Straß ßlicher\n" * 20,
    "x\n" + "STRAß GROß MAß ABC\n" * 15 + "ŉach ǰb ᾀc ΐd ﬁn\n" * 15,
    "ételeconferenceé über é12. Hearing on the water fees é3. Sale of land near the river",
    # a space is the snippet's last character
    "word " * 39 + "word  ends and goes on " * 20,
    "ö1. achö 2. bé\n\nSubject: ö item 3ö\n\nöbudgetö item of the parksü and the riverü",
    "\n".join(["überütel: 5 für die Stadt"] * 14),
    "\n".join(["St ßlichpf x"] * 16),
    "\n\n".join(f"{i}. Hearing on the ücity clerkö fees of water number {i}" for i in range(1, 9)),
]
DIFFERED = ["f13_title_noise", "f14_human_names", "f15_portal_acceptance", "x13_substance", "x13_accepted_items", "x16_agenda_summaries", "x17_bluf_summaries", "a11_agenda_quality", "u8_agenda_sources", "u8_resolved_items", "x14_candidates", "x14_rejections"]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("words"))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT i AS doc_id, t[i % len(t) + 1] AS text, 'en' AS lang, 's' AS source FROM range(36) r(i), (SELECT ? AS t) x", [TEXTS])
    con.execute("CREATE TABLE part AS SELECT i AS p_partkey, 'b' AS p_brand, 't' AS p_type FROM range(36) r(i)")
    con.execute("CREATE TABLE conversations AS SELECT doc_id AS conv_id, 1 AS turn, text || ' padding to forty characters and more' AS text FROM documents UNION ALL SELECT 99, 1, 'the word motionä holds no cue in Java without ASCII words'")
    for name in ("documents", "part", "conversations"):
        con.execute(f"COPY {name} TO '{folder}/{name}.parquet' (FORMAT parquet)")
    for name in ("orders", "lineitem", "customer", "nation", "region", "supplier", "events", "embeddings", "pages", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/sf0.001/{name}.parquet'")
        con.execute(f"COPY {name} TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return folder, con


@pytest.mark.parametrize("name", [*DIFFERED, "a23_vote_outcomes", "x25_flat_titles"])
def test_as_the_sql(spark, small, name):
    folder, con = small
    found = registry.queries()[name](spark, folder)
    wanted = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in wanted.description]
    assert sorted(map(repr, (tuple(r) for r in found.select(*columns).collect()))) == sorted(map(repr, wanted.fetchall()))


def test_bounds(spark):
    assert ascii_bounds(r"\bada\b|\d{3}\b") == r"(?<!\w)ada(?!\w)|\d{3}(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))"
    d = spark.createDataFrame([("üadaß",), ("xada",), ("ada ",), ("ada_",)], "t string")
    assert [r.m for r in d.select(d.t.rlike(ascii_bounds(r"\bada\b")).alias("m")).collect()] == [True, False, True, False]
    assert "ß" in SEVERAL
