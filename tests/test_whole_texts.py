"""Pieces of texts go on to the text's end, however long it is."""

import duckdb
import pytest

from gavel import registry


@pytest.mark.parametrize("name", ["x4_chunks", "x4_long_chunks"])
def test_pieces_are_of_the_whole_text(spark, tmp_path, name):
    texts = [" ".join(f"w{i}" for i in range(9000)) + " end", "x" * 30_000 + " " + "ab " * 9000 + "end", "a\n\t b", None, "", "\xa0 end　"]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT i AS doc_id, t[i % len(t) + 1] AS text FROM (SELECT ? AS t) x, range(30) r(i)", [texts])
    con.execute(f"COPY documents TO '{tmp_path}/documents.parquet' (FORMAT parquet)")
    found = sorted(map(tuple, registry.queries()[name](spark, str(tmp_path)).select("doc_id", "chunk_no", "chunk").collect()))
    assert found == sorted(con.execute(registry.oracle_sql()[name]).fetchall())
    last = {doc: chunk for doc, _, chunk in found}
    assert all(chunk.endswith("end") for doc, chunk in last.items() if doc % 6 in (0, 1, 5)) and max(no for _, no, _ in found) > 10
