"""A model's summary as plain text: the bottom line first, then bullets that the source supports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel.functions.text import ascii_bounds, collapse
from gavel.operators.scores import computed
from gavel.operators.summaries import is_attendance
from gavel.operators.titles import CLAIM_STOP_WORDS

# What a summary says where there is nothing to say, and the beginnings of lines that introduce an answer.
UNAVAILABLE = "Summary unavailable from extracted text."
NO_BULLET = "Summary unavailable."
UNCLEAR = "Key meeting takeaway is unclear from extracted text."
ACKNOWLEDGED = ("okay", "sure", "certainly", "got it", "understood", "i will", "i'll")
MOST_WORDS, MOST_BULLETS, LEAST_BULLETS, LEAST_COVERAGE = 30, 7, 3, 0.45
# Where lines end, page marks, marks of emphasis, of bullets and of numbers, tokens.
LINE_END = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]"
PAGE_MARK = r"(?i)\[PAGE\s+\d+\]\s*"
EMPHASIS = ((r"\*\*(.+?)\*\*", "$1"), (r"__(.+?)__", "$1"), (r"`([^`]+)`", "$1"))
BULLET, NUMBER = r"^\s*[*\-\x{2022}]+\s*", r"^\s*\d+\s*[.)]\s*"
SENTENCE = r"^(.+?[.!?])(\s|$)"
TOKEN = "[a-z0-9']+"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def without_acknowledgement(text: Column) -> Column:
    """A model's answer without the lines before its summary: from the first line that names the bottom line, if only blank lines and acknowledgements lie before it; otherwise without these."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), LINE_END), lambda x: F.regexp_replace(x, r"\s+$", ""))
    low = lambda x: F.lower(F.ltrim(x))
    named = lambda x: F.contains(F.lower(x), F.lit("bluf:"))
    idle = lambda x: (F.trim(x) == "") | low(x).rlike("^(?:" + "|".join(ACKNOWLEDGED) + ")") | low(x).contains("i understand")
    # the first line that stays; a line that names the bottom line stays whatever else it says
    at = F.array_min(F.filter(F.transform(lines, lambda x, i: F.when(named(x) | ~idle(x), i)), lambda i: i.isNotNull()))
    rest = F.slice(lines, at + 1, F.size(lines))
    first = F.element_at(rest, 1)
    begun = trimmed(F.substring(first, F.instr(F.lower(first), "bluf:"), F.length(first)))
    suffix = trimmed(F.array_join(F.slice(rest, 2, F.size(lines)), "\n"))
    return F.when(at.isNull(), "").when(named(first), F.concat_ws("\n", begun, F.nullif(suffix, F.lit("")))).otherwise(trimmed(F.array_join(rest, "\n")))


def _distinct(lines: str) -> str:
    """SQL: the lines of an array column, of those equal but for case the first, in order. By sorting, so not quadratic."""
    keyed = f"array_sort(transform({lines}, (l, i) -> struct(lower(trim(l)) AS k, i AS i, l AS l)))"
    firsts = f"aggregate({keyed}, struct(CAST(NULL AS STRING) AS k, CAST(array() AS ARRAY<STRUCT<i: INT, l: STRING>>) AS kept), (a, x) -> struct(x.k AS k, IF(a.k <=> x.k, a.kept, array_append(a.kept, struct(x.i AS i, x.l AS l))) AS kept), a -> a.kept)"
    return f"transform(array_sort({firsts}), x -> x.l)"


def bluf_summaries(rows: DataFrame, summary: str = "summary", source: str = "source") -> DataFrame:
    """rows with normalized: the summary without introductions, emphasis, attendance and repeats; the bottom line is its first sentence of at most 30 words; at most seven bullets, of which the source's tokens cover enough, topped up to three; if none is left, passages of the source.

    A null or empty summary stays as it is; a null source supports all. A row is worked on alone, in time linear in its texts but for the sorting of its lines.
    """
    d = computed(rows, _summary=F.coalesce(F.col(summary), F.lit("")), _source=F.coalesce(F.col(source), F.lit("")))
    low = lambda x: F.lower(x)
    lines = F.filter(F.transform(F.split("_summary", LINE_END), trimmed), lambda x: (x != "") & ~(low(x).startswith("here") & low(x).contains("summary")) & ~low(x).contains("executive summary") & ~low(x).startswith("summary of the meeting"))
    d = computed(d, _lines=F.transform(lines, _plain))
    d = computed(d, _lines=F.filter("_lines", lambda x: (x != "") & ~is_attendance(x)))
    d = computed(d, _lines=F.expr(_distinct("_lines")))
    d = computed(d, _bullets=F.filter("_lines", lambda x: ~low(x).startswith("bluf:")), _named=F.filter("_lines", lambda x: low(x).startswith("bluf:")))
    said = F.when(F.size("_named") > 0, trimmed(F.substring(F.element_at("_named", -1), F.lit(6), F.length(F.element_at("_named", -1)))))
    said = F.when(F.coalesce(said, F.lit("")) != "", said).otherwise(F.coalesce(F.get("_bullets", 0), F.get("_lines", 0), F.lit("")))
    d = computed(d, _bluf=said)
    d = computed(d, _bluf=trimmed(F.coalesce(F.nullif(F.regexp_extract("_bluf", SENTENCE, 1), F.lit("")), "_bluf")))
    words = F.split("_bluf", r"\s+")
    bare = lambda c: F.regexp_replace(c, "[.,;:]+$", "")
    d = computed(d, _bluf=F.when(F.size(words) > MOST_WORDS, F.concat(bare(F.array_join(F.slice(words, 1, MOST_WORDS), " ")), F.lit("."))).otherwise(F.col("_bluf")))
    d = computed(d, _bluf=F.when((F.col("_bluf") != "") & ~F.col("_bluf").rlike("[.!?]$"), F.concat(bare(F.col("_bluf")), F.lit("."))).otherwise(F.col("_bluf")))
    d = d.withColumn("_bluf", F.when(is_attendance(F.col("_bluf")), UNCLEAR).otherwise(F.col("_bluf")))
    # the claims' tokens that the source holds, by hashing, so that a long source is read once
    claims = F.filter(F.flatten(F.transform("_bullets", _tokens)), lambda x: F.length(x) >= 3)
    d = computed(d, _claims=F.array_distinct(claims), _words=F.array_distinct(_tokens(F.col("_source"))))
    five = lambda c: F.transform(F.filter(c, lambda x: F.length(x) >= 5), lambda x: F.substring(x, 1, 5))
    d = computed(d, _held=F.array_intersect("_claims", "_words"), _begun=F.array_intersect(five("_claims"), five("_words")), _free=F.size("_words") == 0)
    d = computed(d, _marked=F.transform("_bullets", lambda x: F.struct(x.alias("line"), (F.col("_free") | (_coverage(x) >= LEAST_COVERAGE)).alias("held"))))
    d = computed(d, _first=F.filter(F.slice("_marked", 1, MOST_BULLETS), lambda x: x["held"]))
    # lines that were not held before, and lines beyond the first seven, top up to three; only those held stay
    others = F.filter("_marked", lambda x, i: ~x["held"] | (i >= MOST_BULLETS))
    more = F.filter(F.slice(others, 1, F.greatest(F.lit(LEAST_BULLETS) - F.size("_first"), F.lit(0))), lambda x: x["held"])
    few = (F.size("_first") < LEAST_BULLETS) & (F.size("_lines") >= LEAST_BULLETS)
    kept = F.transform(F.when(few, F.concat("_first", more)).otherwise(F.col("_first")), lambda x: x["line"])
    d = computed(d, _kept=kept)
    d = computed(d, _snippet=F.substring(collapse(F.regexp_replace("_source", PAGE_MARK, " ")), 1, 200))
    parts = F.filter(F.transform(F.split(F.regexp_replace(F.regexp_replace("_source", PAGE_MARK, "\n"), r"\s+", " "), ascii_bounds(r"\b\d+\.\s+")), trimmed), lambda x: (F.length(x) >= 12) & ~is_attendance(x))
    none = F.array().cast("array<string>")
    d = computed(d, _parts=F.when(F.size("_kept") == 0, F.slice(parts, 1, MOST_BULLETS)).otherwise(none))
    d = computed(d, _parts=F.expr(_distinct("_parts")))
    spare = F.when(F.size("_parts") > 0, F.col("_parts")).when(F.col("_snippet") != "", F.array("_snippet")).otherwise(F.array(F.lit(UNAVAILABLE)))
    bullets = F.when(F.size("_kept") > 0, F.col("_kept")).otherwise(spare)
    text = F.concat_ws("\n", trimmed(F.concat(F.lit("BLUF: "), "_bluf")), F.transform(bullets, lambda x: F.concat(F.lit("- "), x)))
    empty = F.concat(F.lit(f"BLUF: {UNAVAILABLE}\n- "), F.when(F.col("_snippet") == "", NO_BULLET).otherwise(F.col("_snippet")))
    out = F.when(F.col("_summary") == "", F.col(summary)).when(F.size("_lines") == 0, empty).otherwise(text)
    return d.select(*rows.columns, out.alias("normalized"))


def _plain(line: Column) -> Column:
    for pattern, inner in EMPHASIS:
        line = F.regexp_replace(line, pattern, inner)
    return trimmed(F.regexp_replace(F.regexp_replace(trimmed(line), BULLET, ""), NUMBER, ""))


def _tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def _coverage(claim: Column) -> Column:
    """Share of a claim's longer tokens, stop words aside, that the source holds or, by five letters, begins; 1 if it has none."""
    told = F.filter(_tokens(claim), lambda x: (F.length(x) >= 3) & ~x.isin(*CLAIM_STOP_WORDS))
    held = F.filter(told, lambda x: F.array_contains("_held", x) | ((F.length(x) >= 5) & F.array_contains("_begun", F.substring(x, 1, 5))))
    return F.when(F.size(told) == 0, 1.0).otherwise(F.size(held) / F.size(told))
