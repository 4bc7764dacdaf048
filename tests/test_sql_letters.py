"""Spaces, line ends, letters and nulls beyond the usual are taken as the twins' SQL takes them."""

import duckdb
import pytest

from gavel import registry
from gavel.functions.text import lower, sql_pattern

ODD = ["\x0b", "\r", "\x85", "\xa0", " ", "　", "ſ", "K", "İ", "Σ"]
LINES = ["{c}Call to Order{c}", "Presentation{c}", "public comment{c}", "te{c}l: 5", "Maria Lopez{c}", "Maria{c}", "MARIA{c}ANNA LOPEZ DIAZ ABC", "{c}", "raise hand{c}", "{c}subject: parks", "9:30 am the {c} meeting {c}", "{c}. The big table 1 2 3", "a 1{c}2 3 4 5 6 b", "1. Approve the{c} contract of parks{c}", "ODO{c}"]
ROWS = ["a23_vote_outcomes", "f13_title_noise", "f14_human_names", "f15_portal_acceptance", "x13_substance", "x13_accepted_items", "u8_resolved_items", "x14_candidates"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("letters"))
    con = duckdb.connect()
    texts = ["\n".join(line.replace("{c}", c) for line in LINES[k:] + LINES[:k]) for c in ODD for k in (0, 4, 8, 12)]
    con.execute("CREATE TABLE documents AS SELECT i AS doc_id, CASE WHEN i % 41 > 0 THEN t[i % len(t) + 1] END AS text, 'en' AS lang, 's' AS source FROM range(164) r(i), (SELECT ? AS t) x", [texts])
    con.execute("CREATE TABLE part AS SELECT doc_id AS p_partkey, 'b' AS p_brand, 't' AS p_type FROM documents")
    con.execute("CREATE TABLE conversations AS SELECT doc_id AS conv_id, doc_id % 4 AS turn, CASE WHEN doc_id % 9 > 0 THEN text END AS text FROM documents UNION ALL SELECT 999, 1, 'the ayeſ have it, and nothing else is said here'")
    for name in ("documents", "part", "conversations"):
        con.execute(f"COPY {name} TO '{folder}/{name}.parquet' (FORMAT parquet)")
    for name in ("orders", "lineitem", "customer", "nation", "region", "supplier", "events", "embeddings", "pages", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/sf0.001/{name}.parquet'")
        con.execute(f"COPY {name} TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return folder, con


@pytest.mark.parametrize("name", ROWS)
def test_as_the_sql(spark, odd, name):
    folder, con = odd
    found = registry.queries()[name](spark, folder)
    wanted = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in wanted.description]
    assert sorted(map(repr, (tuple(r) for r in found.select(*columns).collect()))) == sorted(map(repr, wanted.fetchall()))


def test_patterns_and_letters(spark):
    assert sql_pattern(r"a\sb$") == r"(?d)a[\t\n\f\r ]b\z"
    assert sql_pattern(r"(?im)^x\s*[\s-]$") == r"(?dim)^x[\t\n\f\r ]*[\t\n\f\r -]$"
    d = spark.createDataFrame([("İΣ AΣ",)], "t string")
    assert d.select(lower(d.t)).first()[0] == "iσ aσ"
