"""Rules work a title's forms out once, and texts are read before they meet other tables."""

import pytest
from pyspark.sql import functions as F

from gavel import registry
from gavel.functions.text import ascii_bounds
from gavel.operators import quality, scores, segmentation, summaries, titles


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("rule, most", [(titles.is_procedural, 2), (titles.is_contact, 1), (quality.is_boilerplate, 1), (quality.is_name_like, 2), (summaries.is_segment_noise, 1), (summaries.is_line_fragment, 1), (scores.is_human_name, 3), (segmentation.is_person, 6), (segmentation.is_noise_title, 5)])
def test_a_title_is_replaced_in_once(spark, rule, most):
    d = spark.createDataFrame([("x",)], "t string")
    assert plan(d.select(rule(d.t).alias("x"))).count("regexp_replace(") <= most


def test_a_group_of_words_begins_as_a_word():
    assert ascii_bounds(r"\b(tel|e-?mail)\s*:") == r"(?<!\w)(tel|e-?mail)\s*:"
    bound = r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))"
    for p in ("(x?a|b)", r"(a[|x]b|\d)", "((a)|b)", "(a|)x", "(?:the)? -", "([ab]|c)"):
        assert ascii_bounds(r"\b" + p) == bound + p


def test_no_title_is_shuffled_to_count_it(spark):
    items = spark.createDataFrame([(1, 1, "a", None, None)], "catalog_id long, page_number long, title string, description string, result string")
    assert "md5" in plan(scores.quality_scores(items, "catalog_id"))


def test_texts_are_read_before_they_meet_parts(spark):
    lines = plan(registry.queries()["a10_worst_catalogs"](spark, "/root/testdata/sf0.001")).split("\n")
    found = next(i for i, line in enumerate(lines) if "regexp_extract_all" in line)
    assert any("Join Inner" in line for line in lines[:found]) and not any("Join Inner" in line for line in lines[found:])
