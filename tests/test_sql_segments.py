"""Candidates are as in the twins' SQL: blanks before a numbered line, paragraphs in a row and marks in a text (these two once differed), spaces in lines that end an agenda."""

import duckdb
import pytest

from gavel import registry

ADVICE = ["1. Subject: Zoning of Oak Lane\nRecommendation: take the following action\n" + "x" * n + ".\n" * 2 + blanks + "2. Modify the parking requirements\nSubject matter" for n in range(455, 466) for blanks in ("\n\n", "\n \n", " \t\n")]
TEXTS = [
    *ADVICE,
    "1. Subject: Zoning of Oak Lane\nRecommendation: would:\n" + "x" * 470 + "\n" + "\n2. " + " " * 9 + "\n" * 20 + "3. Modify the parking requirements",
    "Hearing on the water fees\nReview of the parks budget\nSale of land near the river.",
    "Sale of land\nItem 7\nHearing on the water fees and the budget\nSubject: Review of it all\n7. \nSubject: Adopt the budget of the year",
    *("1. Approve the Budget Update\n" + end + "\nOfficial Seal, City Clerk\n2. Award the Paving Contract" for end in ("IN WITNESS  WHEREOF", "in witness\twhereof I", "\xa0Adjournment", "Adjournment\x0b", "offİcial  seal", "Public  notice of the\rofficial  agenda")),
    "a \x01 b\n1. Approve the\x01 mural design\n[PAGE 2]\x01\n2. Award\x01\x01 the Paving Contract\nsee \x01Page 3\nNext\n\x01Page 4\n3. Adopt the Fee Schedule",
    "\x01",
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("segments"))
    con = duckdb.connect()
    # every twelfth document is taken as it is
    con.execute("CREATE TABLE documents AS SELECT 12 * i + 11 AS doc_id, t[i + 1] AS text, 'en' AS lang, 's' AS source FROM (SELECT ? AS t) x, range(len(t)) r(i)", [TEXTS])
    con.execute(f"COPY documents TO '{folder}/documents.parquet' (FORMAT parquet)")
    return folder, con


@pytest.mark.parametrize("name", ["x14_candidates", "x14_rejections"])
def test_as_the_sql(spark, odd, name):
    folder, con = odd
    found = registry.queries()[name](spark, folder)
    wanted = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in wanted.description]
    assert sorted(map(repr, (tuple(r) for r in found.select(*columns).collect()))) == sorted(map(repr, wanted.fetchall()))
