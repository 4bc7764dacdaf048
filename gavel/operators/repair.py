"""Repair of extracted texts: spaced capitals, fragmented headings, topics' texts, outcomes of a new extraction."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavel.functions.text import content_hash
from gavel.operators.records import extraction_state
from gavel.operators.titles import bad_content

# Words that headings of minutes and agendas are made of.
LEXICON = (
    "A", "AN", "AND", "AS", "AT", "BY", "FOR", "FROM", "IN", "IS", "OF", "ON", "OR", "THE", "TO", "WITH", "WILL", "THIS", "THAT", "AGENDA",
    "ANNOTATED", "CITY", "COUNCIL", "MEETING", "SPECIAL", "PROCLAMATION", "CALLING", "SESSION", "REGULAR", "PUBLIC", "HEARING", "RESOLUTION",
    "ORDINANCE", "COMMISSION", "BOARD", "PLANNING", "ZONING", "ITEM", "CLOSED", "BERKELEY", "CUPERTINO", "PABLO", "AVENUE", "CORRIDORS", "CA",
)
# Lines that are never repaired, and what a spaced word looks like.
UNSAFE = r"https?://|www\.|@|\b\d{1,3}(?:\.\d{1,3}){3}\b|\b\d{3}[-\.\s]?\d{3}[-\.\s]?\d{4}\b|\b(?:JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)[A-Z]*\b|\b\d{1,2}[:/]\d{1,2}\b"
SPACED = r"\b(?:[A-Z]\s++(?=[A-Z]\b)){2,}+[A-Z]"  # possessive: no stack is used on long runs
CAPS = r"^[A-Z]{1,6}$"
LINE_END = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85]"
_LONGEST = 20
_KNOWN = frozenset(LEXICON)


def joined_capitals(text: Column) -> Column:
    """Three or more single capitals with white space between them as one word; where there were two or more characters (or a line's end) between, as two."""
    value = F.coalesce(text, F.lit(""))
    gaps = F.split(value, SPACED)
    words = F.transform(F.regexp_extract_all(value, F.lit(SPACED), 0), lambda m: F.replace(F.regexp_replace(F.regexp_replace(m, r"\s*\n\s*|\s{2,}", "|"), r"\s", ""), F.lit("|"), F.lit(" ")))
    return F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(words, i), F.lit("")))), "")


def fragment_score(line: Column) -> Column:
    """0 to 1: how much a line looks like a broken heading in capitals; 0 with fewer than three words in capitals."""
    words = F.filter(F.split(line, r"\s+"), lambda w: w != "")
    caps = F.filter(words, lambda w: w.rlike(CAPS))
    n = F.size(caps)
    short, single = F.size(F.filter(caps, lambda w: F.length(w) <= 2)), F.size(F.filter(caps, lambda w: F.length(w) == 1))
    score = 0.45 * short / n + 0.25 * single / n + 0.30 * n / F.size(words) + F.when(n >= 6, 0.2).otherwise(0.0)
    return F.when(n >= 3, F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))).otherwise(F.lit(0.0))


def is_repairable(line: Column) -> Column:
    """A heading in capitals of at most 220 characters, without links, numbers or dates, and fragmented (score 0.5 or more)."""
    letters = F.regexp_replace(line, "[^A-Za-z]", "")
    capitals = F.length(F.regexp_replace(letters, "[^A-Z]", "")) / F.greatest(F.length(letters), F.lit(1))
    return (F.length(line) <= 220) & ~line.rlike(UNSAFE) & (F.length(letters) >= 8) & (capitals >= 0.8) & (fragment_score(line) >= 0.5)


def cheapest_words(letters: str) -> list[str]:
    """The split of least cost in tenths: known words 1, single letters 20, others 10 and 1 for each letter; at most 20 letters each."""
    best = [(0, 0)]
    for end in range(1, len(letters) + 1):
        ways = []
        for begin in range(max(0, end - _LONGEST), end):
            part = letters[begin:end]
            ways.append((best[begin][0] + (1 if part in _KNOWN else 20 if len(part) == 1 else 10 + len(part)), begin))
        best.append(min(ways))
    words, end = [], len(letters)
    while end:
        words.append(letters[best[end][1] : end])
        end = best[end][1]
    return words[::-1]


def _score(words: list[str]) -> float:
    caps = [w for w in words if 1 <= len(w) <= 6 and all("A" <= c <= "Z" for c in w)]
    if len(caps) < 3:
        return 0.0
    few = [sum(len(w) <= k for w in caps) / len(caps) for k in (2, 1)]
    return min(1.0, 0.45 * few[0] + 0.25 * few[1] + 0.30 * len(caps) / len(words) + (0.2 if len(caps) >= 6 else 0.0))


def repaired_heading(line: str) -> str:
    """A repairable line with its runs of words in capitals split anew, if that lowers its score by 0.15 and makes no word over 26 letters."""
    words, out, run = line.split(), [], []
    for w in [*words, None]:
        if w and len(w) <= 6 and all("A" <= c <= "Z" for c in w):
            run.append(w)
            continue
        parts = cheapest_words("".join(run)) if len(run) >= 3 else run
        keep = len(run) == 3 and len(parts) == 1 and len(parts[0]) <= _LONGEST
        out += run if keep else parts
        out += [w] if w else []
        run = []
    better = _score(out) <= _score(words) - 0.15 and all(len(w) <= 26 for w in out)
    return " ".join(out) if better else line


def _repaired(lines: pd.Series) -> pd.Series:
    return lines.map(lambda found: [repaired_heading(x) for x in found])


def repair_text(df: DataFrame, text: str = "text", out: str = "repaired") -> DataFrame:
    """df with out: the text with its spaced capitals and broken headings mended, no blanks at lines' ends, at most two empty lines. Null gives the empty text. Columns beside text pass through.

    Scores are native; only the lines that may be repaired go to Python, once for each text. No shuffle.
    """
    d = df.withColumn("_lines", F.split(joined_capitals(F.col(text)), LINE_END))
    d = d.withColumn("_broken", F.array_distinct(F.filter("_lines", is_repairable)))
    d = d.withColumn("_mended", F.pandas_udf(_repaired, "array<string>")("_broken"))
    fixed = F.transform("_lines", lambda x: F.coalesce(F.get(F.col("_mended"), (F.array_position("_broken", x) - 1).cast("int")), x))
    whole = F.regexp_replace(F.regexp_replace(F.array_join(fixed, "\n"), r"[ \t]+\n", "\n"), r"\n{4,}", "\n\n\n")
    return d.withColumn(out, F.regexp_replace(whole, r"^\s+|\s+$", "")).drop("_lines", "_broken", "_mended")


def topic_text(repaired: Column) -> Column:
    """A repaired text without links, words of their schemes and page marks, each as a space."""
    for p in (r"(?i)https?://\S+", r"(?i)www\.\S+", r"(?i)\bhttps?\b", r"(?i)\bwww\b", r"(?i)\[PAGE\s+\d+\]"):
        repaired = F.regexp_replace(repaired, p, " ")
    return repaired


def reextracted(catalog: DataFrame, extracted: DataFrame, least: int, force: bool = False) -> DataFrame:
    """catalog_id, outcome (cached, updated, failed), content, content_hash, state, attempts, error after a new extraction.

    catalog: catalog_id, content, location, attempts; extracted: catalog_id, text (one row for each file that was read; none: not found). Without a location nothing is read; a text of least characters or more stays unless force; an empty or bad text is a failure and the content stays.
    """
    new = repair_text(extracted.select("catalog_id", "text")).select("catalog_id", "text", "repaired")
    d = catalog.join(new.withColumn("_file", F.lit(True)), "catalog_id", "left")
    old = F.regexp_replace(F.coalesce("content", F.lit("")), r"^\s+|\s+$", "")
    located = (F.coalesce("location", F.lit("")) != "") & (F.col("location") != "placeholder")
    cached = (F.length(old) >= F.lit(least)) & (old != "") & F.lit(not force)
    error = F.when(~located, "Catalog has no file location").when(F.col("_file").isNull(), "File not found on disk").when(cached, None).when(F.coalesce("text", F.lit("")) == "", "Extraction returned empty text").otherwise(bad_content(F.col("repaired")))
    d = d.withColumn("_error", error).withColumn("_cached", located & F.col("_file").isNotNull() & cached)
    after = extraction_state(F.col("_error").isNull(), F.col("attempts"), F.col("_error"))
    changed = F.col("_error").isNull() & ~F.col("_cached")
    content = F.when(changed, F.col("repaired")).otherwise(F.col("content"))
    outcome = F.when(F.col("_error").isNotNull(), "failed").when(F.col("_cached"), "cached").otherwise("updated")
    return d.select("catalog_id", outcome.alias("outcome"), content.alias("content"), content_hash(content).alias("content_hash"), after["state"].alias("state"), after["attempts"].alias("attempts"), after["error"].alias("error"))
