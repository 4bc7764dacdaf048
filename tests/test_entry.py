import os

import pytest

import __spark_entry__ as entry_point

SMALL = "/root/testdata/sf0.001"


def test_every_oracle_has_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the small tables")
def test_entry_gives_rows(spark):
    assert entry_point.entry(spark).count() > 0
