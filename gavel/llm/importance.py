"""Target-distribution importance resampling over hashed words (operator 11).

Features are the runs of 1 to n consecutive words of a text; a feature's bucket is
its crc32 modulo the number of buckets. A head-tail vocabulary makes the buckets
cheap: words that hold over one in HEAD of a corpus keep their exact CRC state in
a table that goes to every task, and frequent pairs their bucket; any other
feature takes its CRC directly, a longer run by carrying on the state of the
run before. Head and tail give the same number for the same feature, so both
feed exact bucket totals. A bucket's gain is the floored log ratio of its share in
the target and in the documents; a text's weight is the mean gain of its features,
and the highest weights plus a Gumbel number drawn from the key are the sample.

A batch of texts names the words that hold over one in HEAD of it: a word that
holds over one in HEAD of the corpus does so in some batch. Fewer than HEAD words
of at most WORD_BYTES come through, so what goes to each task is bounded, as are
the bucket totals and the two histograms from which the least drawn score is read.
Only rows of that score and more are sorted, in ranges.

Defined results: a null or empty text, or one without words, has no features and
weight 0; a null key draws its number as an empty string and comes before others
in ties; rows that repeat a key are rows of their own (ties go on by number of
features, and equal rows are interchangeable); long texts are worked on in pieces;
an empty table gives no rows, an empty target a gain for every bucket as any
other; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import PIECE_BYTES, as_bytes, bounded_batches, cut, groups

#: Fewer words, and fewer pairs, than this are in the head; none is longer than WORD_BYTES.
HEAD, WORD_BYTES = 4096, 64
#: Scores are counted in steps of this, then one by one within the step that holds the last one drawn.
STEP = 256

#: A word is made of what is not in \x00-\x2F, \x3A-\x60, \x7B-\x7F, once A-Z are a-z.
_FOLD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


class States(dict):
    """CRC states of head words; any other word's is worked out."""

    def __missing__(self, word: bytes) -> int:
        return zlib.crc32(word)


def _pieces(data: bytes) -> Iterator[list[bytes]]:
    """Lists of consecutive words; a long text gives several."""
    at = 0
    while at < len(data):
        end = min(len(data), at + PIECE_BYTES)
        piece = data[at:end].translate(_FOLD)
        if end < len(data):
            gap = piece.rfind(b" ")
            if gap < 0:  # a word longer than a piece
                while end < len(data) and _FOLD[data[end]] != 0x20:
                    end += 1
                piece = data[at:end].translate(_FOLD)
            else:
                end, piece = at + gap + 1, piece[: gap + 1]
        yield piece.split()
        at = end


def _runs(words: list[bytes], before: list[bytes], n: int, states: States, pairs: dict[bytes, int], buckets: int) -> np.ndarray:
    """Buckets of all runs of 1 to n words that end in words; before has up to n - 1 words that precede them."""
    found = [np.fromiter(map(states.__getitem__, words), np.int64, len(words)) % buckets]
    if n > 1:
        words = before + words
        state = list(map(states.__getitem__, words))
        for k in range(2, n + 1):
            ends = range(max(k - 1, len(before)), len(words))
            state = {i - k + 1: zlib.crc32(b" " + words[i], state[i - k + 1]) for i in range(k - 1, len(words))}
            if k == 2:
                run = [p if (p := pairs.get(words[i - 1] + b" " + words[i])) is not None else state[i - 1] % buckets for i in ends]
            else:
                run = [state[i - k + 1] % buckets for i in ends]
            found.append(np.array(run, dtype=np.int64))
    return np.concatenate(found)


def features(data: bytes, n: int, states: States, pairs: dict[bytes, int], buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """A text piece by piece: its number of words and the buckets of the features that end in it."""
    before: list[bytes] = []
    for words in _pieces(data):
        yield len(words), _runs(words, before, n, states, pairs, buckets)
        before = (before + words)[-(n - 1) :] if n > 1 else []


def head(texts: DataFrame, text: str = "text", n: int = 1, least: int = HEAD) -> tuple[States, dict[bytes, int]]:
    """CRC states of the frequent words, and those of frequent pairs if n is over 1."""
    bounded_batches(texts.sparkSession)

    def name(batches):
        import pyarrow as pa

        for batch in batches:
            data = as_bytes(batch.column(0))
            for a, b in groups(data):
                counts = [Counter(), Counter()]
                for t in data[a:b]:
                    last: list[bytes] = []
                    for words in _pieces(t):
                        counts[0].update(words)
                        if n > 1:
                            run = last + words
                            counts[1].update(x + b" " + y for x, y in zip(run, run[1:], strict=False))
                            last = words[-1:]
                kinds, names, sizes = [], [], []
                for kind, found in enumerate(counts):
                    total = sum(found.values())
                    frequent = [(w, c) for w, c in found.items() if c * least > total and len(w) <= WORD_BYTES]
                    for w, c in [(None, total), *frequent]:
                        kinds.append(kind)
                        names.append(w)
                        sizes.append(c)
                yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(names, pa.binary()), pa.array(sizes, pa.int64())], ["kind", "name", "n"])

    counted = cut(texts.select(text).mapInArrow(name, "kind int, name binary, n long").groupBy("kind", "name").agg(F.sum("n").alias("n")))
    totals = counted.filter("name IS NULL").select("kind", F.col("n").alias("total"))  # two rows
    frequent = counted.filter("name IS NOT NULL").join(F.broadcast(totals), "kind").filter(F.col("n") * least > F.col("total"))
    states, pairs = States(), {}
    for r in frequent.select("kind", "name").collect():  # fewer than HEAD of each kind
        (pairs if r.kind else states)[bytes(r.name)] = zlib.crc32(r.name)
    return states, pairs


def totals(texts: DataFrame, vocabulary: tuple[States, dict[bytes, int]], text: str = "text", n: int = 1, buckets: int = 10_000) -> DataFrame:
    """(bucket, n): how many features of all texts fall in each bucket, for those that have any."""
    bounded_batches(texts.sparkSession)
    states, pairs = vocabulary[0], {w: s % buckets for w, s in vocabulary[1].items()}

    def count(batches):
        import pyarrow as pa

        sums = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for t in as_bytes(batch.column(0)):
                for _, found in features(t, n, states, pairs, buckets):
                    if len(found) * 8 > buckets:
                        sums += np.bincount(found, minlength=buckets)
                    else:
                        np.add.at(sums, found, 1)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(sums[some])], ["bucket", "n"])

    return texts.select(text).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = 10_000) -> list[int]:
    """floor(1000 * ln of the ratio of smoothed shares) for each bucket, from two tables of totals."""
    spark = corpus.sparkSession
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # a row for each bucket
    both = (
        spark.range(buckets).withColumnRenamed("id", "bucket")
        .join(corpus.withColumnRenamed("n", "s"), "bucket", "left")
        .join(target.withColumnRenamed("n", "t"), "bucket", "left")
        .select("bucket", F.coalesce("s", F.lit(0)).cast("double").alias("s"), F.coalesce("t", F.lit(0)).cast("double").alias("t"))
        .select("bucket", "s", "t", F.sum("s").over(every).alias("all_s"), F.sum("t").over(every).alias("all_t"))
    )
    ratio = ((F.col("t") + 1) * (F.col("all_s") + buckets)) / ((F.col("s") + 1) * (F.col("all_t") + buckets))
    out = [0] * buckets
    for r in both.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")).collect():
        out[r.bucket] = r.gain
    return out


def weights(docs: DataFrame, gain: list[int], vocabulary: tuple[States, dict[bytes, int]], key: str = "doc_id", text: str = "text", n: int = 1) -> DataFrame:
    """key, n_words, n_features and weight, the floored mean gain of a text's features."""
    bounded_batches(docs.sparkSession)
    buckets, value = len(gain), np.array(gain, dtype=np.int64)
    states, pairs = vocabulary[0], {w: s % buckets for w, s in vocabulary[1].items()}
    schema = docs.select(F.col(key).alias("key")).schema.add("n_words", "long").add("n_features", "long").add("weight", "long")

    def weigh(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for t in as_bytes(batch.column(1)):
                n_words = n_features = total = 0
                for count, found in features(t, n, states, pairs, buckets):
                    n_words, n_features, total = n_words + count, n_features + len(found), total + int(value[found].sum())
                rows.append((n_words, n_features, total // n_features if n_features else 0))
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["key", "n_words", "n_features", "weight"])

    return docs.select(F.col(key).alias("key"), text).mapInArrow(weigh, schema)


def gumbel(key: Column, seed: int) -> Column:
    """floor(1000 * a Gumbel number), drawn from the key alone."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def _least_drawn(eligible: DataFrame, draw: int) -> int:
    """The score of row number draw from the top."""
    step = F.floor(F.col("score") / STEP)
    above = 0
    for r in eligible.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():  # scores span a few hundred steps
        if above + r["count"] >= draw:
            break
        above += r["count"]
    for s in eligible.filter(step == r.step).groupBy("score").count().orderBy(F.desc("score")).collect():  # at most STEP rows
        above += s["count"]
        if above >= draw:
            return s.score
    raise AssertionError("fewer rows than are to be drawn")


def resample(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text",
    n: int = 1, buckets: int = 10_000, percent: int = 10, min_words: int = 20, seed: int = 2024,
) -> DataFrame:
    """key, n_features, weight, score and rank (from 1; null if not drawn) of every row of docs."""
    spark = docs.sparkSession
    vocabulary = head(docs, text, n)
    gain = gains(totals(docs, vocabulary, text, n, buckets), totals(target, vocabulary, target_text, n, buckets), buckets)
    scored = cut(weights(docs, gain, vocabulary, key, text, n).withColumn("score", F.col("weight") + gumbel(F.col("key"), seed)))
    eligible = scored.filter(F.col("n_words") >= min_words)
    draw = eligible.count() * percent // 100
    out = [F.col("key").alias(key), "n_features", "weight", "score"]
    nobody = F.lit(None).cast("long").alias("rank")
    if not draw:
        return scored.select(*out, nobody)
    least = _least_drawn(eligible, draw)
    order = [F.desc("score"), F.asc_nulls_first("key"), F.asc("n_features"), F.asc("_row")]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the ranges come from a sample, so they are fixed by writing them down
    top = cut(eligible.filter(F.col("score") >= least).withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    offsets = top.groupBy("_range").agg(F.count("*").alias("_rows")).select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    ranked = top.join(F.broadcast(offsets), "_range").withColumn("rank", rank)
    drawn = ranked.select(*out, F.when(F.col("rank") <= draw, F.col("rank")).alias("rank"))
    others = scored.filter((F.col("n_words") < min_words) | (F.col("score") < least)).select(*out, nobody)
    return drawn.unionByName(others)


def sample(docs: DataFrame, target: DataFrame, key: str = "doc_id", **parameters) -> DataFrame:
    """The rows of docs that are drawn, all columns unchanged; rows that repeat a drawn key come with it."""
    drawn = resample(docs, target, key, **parameters).filter("rank IS NOT NULL").select(F.col(key).alias("_drawn")).distinct()
    return docs.join(drawn, docs[key].eqNullSafe(drawn["_drawn"]), "left_semi")
