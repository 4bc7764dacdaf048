"""Quality rules by distribution divergence (operator 6, DataFrame functions only).

Base rules count words, symbols, repeated lines and words in repeated five-word
windows. The method's verdict compares two histograms of a document with those
of its language: character classes, and the language's commonest words. The
distance is Jensen-Shannon's (square root of the divergence in bits, 0 to 1). The
references are fitted on all documents: each language's histograms are summed
over the whole table. A histogram counts only from a minimum length on, below
which the verdict is to keep.

Defined results: a null or empty text has no words and fails the base rules;
rows may repeat; a null or unknown language is compared with the sum of all; an
empty table gives no rows; input columns of the names made here are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Common short words of each language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a"],
    "fr": ["de", "la", "le", "et", "les", "des"],
    "es": ["de", "la", "que", "el", "en", "los"],
    "de": ["der", "die", "und", "in", "den", "von"],
}
#: Least code points in words for the character classes, least words for the common words.
MIN_CHARS, MIN_WORDS = 200, 60
#: Greatest distances that are kept.
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.25, 0.42
WORDS = sorted({w for words in COMMON_WORDS.values() for w in words})
MADE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept"]


def _without(c: str, pattern: str) -> str:
    return f"length(regexp_replace({c}, '{pattern}', ''))"


def measure(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """df with the base counts, base_failed, the language group _lang and the histograms _classes and _hits.

    Arrays that a lambda reads from outside are kept as columns of their own, so that they are made once a row.
    """
    known = ", ".join(f"'{x}'" for x in COMMON_WORDS)
    common = ", ".join(f"'{w}'" for w in WORDS)
    d = df.drop(*MADE).withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    d = d.withColumn("_lang", F.expr(f"CASE WHEN {lang} IN ({known}) THEN {lang} ELSE '*' END"))
    d = d.withColumn("_w", F.expr(r"array_remove(split(_t, '[\\x20\\x09-\\x0D]+'), '')"))
    # what is neither letter nor white space; the commonest words with room around each; lines with a word
    d = d.withColumn("_rest", F.regexp_replace("_t", r"[\p{L}\x20\x09-\x0D]+", ""))
    d = d.withColumn("_common", F.expr(f"concat(' ', array_join(filter(_w, w -> w IN ({common})), '  '), ' ')"))
    d = d.withColumn("_lines", F.expr(r"filter(split(_t, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')"))
    d = d.withColumn("n_words", F.size("_w").cast("long")).withColumn("word_chars", F.expr("length(array_join(_w, ''))").cast("long"))
    d = d.withColumn("n_symbols", F.expr(r"length(_rest) - " + _without("_rest", "[#*$%&|<>]+")).cast("long"))
    d = d.withColumn("n_dup_lines", F.expr("size(_lines) - size(array_distinct(_lines))").cast("long"))
    d = d.withColumn("_upper", F.expr(_without("_t", r"[^\\p{Lu}]+"))).withColumn("_digits", F.expr("length(_rest) - " + _without("_rest", r"\\p{Nd}+")))
    d = d.withColumn("_classes", F.expr("array(word_chars - length(_rest) - _upper, CAST(_upper AS LONG), CAST(_digits AS LONG), n_symbols, length(_rest) - _digits - n_symbols)"))
    counts = ", ".join(f"CAST((length(_common) - length(replace(_common, ' {w} ', ''))) div {len(w) + 2} AS LONG)" for w in WORDS)
    d = d.withColumn("_hits", F.expr(f"array({counts})"))
    # hashes of five-word windows; where some recur, the hashes sorted with their places, the places of those equal to a neighbour, and the measure of the union of their words
    d = d.withColumn("_h", F.expr("transform(_w, w -> xxhash64(w))"))
    d = d.withColumn("_g2", F.expr("zip_with(_h, slice(_h, 2, greatest(size(_h), 1)), (a, b) -> xxhash64(a, b))"))
    d = d.withColumn("_g4", F.expr("zip_with(_g2, slice(_g2, 3, greatest(size(_h), 1)), (a, b) -> xxhash64(a, b))"))
    d = d.withColumn("_g", F.expr("slice(zip_with(_g4, slice(_h, 5, greatest(size(_h), 1)), (a, b) -> xxhash64(a, b)), 1, greatest(size(_h) - 4, 0))"))
    d = d.withColumn("_s", F.expr("CASE WHEN size(array_distinct(_g)) < size(_g) THEN array_sort(transform(_g, (g, i) -> struct(g AS g, i AS i))) ELSE CAST(array() AS ARRAY<STRUCT<g: BIGINT, i: INT>>) END"))
    d = d.withColumn("_p", F.expr("array_sort(transform(filter(_s, (x, k) -> x.g = get(_s, k - 1).g OR x.g = get(_s, k + 1).g), x -> x.i))"))
    d = d.withColumn("n_repeat_words", F.expr("aggregate(_p, struct(-5 AS at, 0L AS n), (a, p) -> struct(p AS at, a.n + least(5, p - a.at) AS n), a -> a.n)"))
    d = d.withColumn("base_failed", F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words"))
    return d.select(*[c for c in df.columns if c not in MADE], "_lang", "_classes", "_hits", *MADE[:6])


def references(measured: DataFrame) -> DataFrame:
    """Fitted on every document: a row for each known language and one, *, for all together (so at most one more than COMMON_WORDS has), with the summed histograms."""
    sums = [F.sum(F.col("_classes")[i]).alias(f"c{i}") for i in range(5)] + [F.sum(F.col("_hits")[i]).alias(f"h{i}") for i in range(len(WORDS))]
    r = measured.rollup("_lang").agg(F.grouping("_lang").alias("_all"), F.sum("n_words").alias("_n"), *sums).filter("_all = 1 OR _lang <> '*'")
    return r.select(
        F.when(F.col("_all") == 1, "*").otherwise(F.col("_lang")).alias("_lang"),
        F.array(*(f"c{i}" for i in range(5))).alias("_ref_classes"),
        F.array(*(f"h{i}" for i in range(len(WORDS))), F.expr("_n - (" + " + ".join(f"h{i}" for i in range(len(WORDS))) + ")")).alias("_ref_hits"),
    )


def _with_distance(d: DataFrame, name: str, p: str, q: str) -> DataFrame:
    """d with the Jensen-Shannon distance of two arrays of counts; null if either is all zeros."""
    term = "CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0D END"
    both = f"({term.format(a='x', b='y')}) + ({term.format(a='y', b='x')})"
    d = d.withColumns({f"{c}_sum": F.expr(f"aggregate({c}, 0D, (s, x) -> s + x)") for c in (p, q)})
    value = F.expr(f"sqrt(greatest(0D, aggregate(zip_with(transform({p}, x -> x / {p}_sum), transform({q}, x -> x / {q}_sum), (x, y) -> {both}), 0D, (s, x) -> s + x) / 2))")
    return d.withColumn(name, F.when((F.col(f"{p}_sum") > 0) & (F.col(f"{q}_sum") > 0), value))


def verdict(measured: DataFrame, reference: DataFrame) -> DataFrame:
    """measured with class_distance, word_distance and kept, without the histograms."""
    d = measured.withColumn("_hits", F.expr("concat(_hits, array(n_words - aggregate(_hits, 0L, (s, x) -> s + x)))"))
    d = d.join(F.broadcast(reference), "_lang", "left")
    d = _with_distance(_with_distance(d, "class_distance", "_classes", "_ref_classes"), "word_distance", "_hits", "_ref_hits")
    odd = f"(word_chars >= {MIN_CHARS} AND class_distance > {MAX_CLASS_DISTANCE}) OR (n_words >= {MIN_WORDS} AND word_distance > {MAX_WORD_DISTANCE})"
    d = d.withColumn("kept", F.expr(f"NOT base_failed AND NOT coalesce({odd}, false)"))
    return d.select(*[c for c in measured.columns if not c.startswith("_")], *MADE[6:])


def _judged(df: DataFrame, text: str, lang: str) -> DataFrame:
    """row (the input row as one struct, so no name of it clashes), the measures and the verdict.

    The measured rows are written down: one scan serves references and verdicts, and a filter on kept is not pushed into the measures, where it would repeat them.
    """
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    measured = cut(measure(rows).drop("text", "lang"))
    return verdict(measured, references(measured))


def judge(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """df with the base counts, base_failed, class_distance, word_distance and kept, which replace columns of these names."""
    return _judged(df, text, lang).select(*[F.col("row").getField(c).alias(c) for c in df.columns if c not in MADE], *MADE)


def keep(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of df that the rules keep, all their columns as they are."""
    return _judged(df, text, lang).filter("kept").select(*[F.col("row").getField(c).alias(c) for c in df.columns])


def judge_keys(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The same for each row's key alone; what is written down is narrow."""
    narrow = cut(measure(df.select(key, text, lang), text, lang).drop(text, lang))
    return verdict(narrow, references(narrow))
