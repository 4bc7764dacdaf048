"""Removal of long repeated passages by recompression (operator 8).

A text is a sequence of word names. Each round first gives every maximal run of
one symbol a name, then every pair whose left symbol is in the round's left half
of the alphabet and whose right symbol is not. Names are 64-bit fingerprints of
what they stand for, so all tasks give the same name without a table of names.
Whether a symbol arises depends on a few neighbours only; that interval of words
is kept with each symbol. Equal substrings therefore hold the same symbols inside.

Over the symbols of the last round, the least of each stretch of GRAMS names of
GRAM consecutive symbols is an anchor. A window of WINDOW words has the anchor of
its first stretch that depends on words of the window alone; a window without one
(long runs, say) is its own anchor. Either follows from the window's words, so
equal windows have equal anchors. Spark counts the anchors; those in one text only
drop out, and of the others' windows the fingerprints are compared: a window is
removed where its fingerprint starts in a document with a smaller doc_id.

Defined results: a null or empty text has no words and nothing is removed; texts
below WINDOW words lose nothing; of equal texts all but those with the least doc_id
go whole; a null doc_id is neither compared nor changed; doc_id identifies a text
(rows of one doc_id and text get the same result each); an empty table gives no
rows; other columns are kept by remove_repeats and ignored by digest.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NARROW_ROWS, as_bytes, bounded_batches, cut, drop, fresh, groups, hot_keys, mix, sequence_digest, signed, spread_join, words_of

WINDOW = 50
ROUNDS, GRAM, GRAMS = 3, 3, 9

_A, _B, _C = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def _neighbours(x: np.ndarray, doc: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each symbol the value left of it and right of it; at the ends of a document, before and after."""
    left, right = before[doc], after[doc]
    same = doc[1:] == doc[:-1]
    left[1:][same] = x[0][:-1][same]
    right[:-1][same] = x[1][1:][same]
    return left, right


def recompress(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols after the rounds, with the first and last word that each depends on, and its document. first: where each document's words begin, one more at the end."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    before, after = first[:-1] - 1, first[1:]  # words that no window of the document holds
    sym, lo, hi = h, np.arange(len(h)), np.arange(len(h))
    for r in range(ROUNDS):
        head = np.ones(len(sym), dtype=bool)
        head[1:] = (sym[1:] != sym[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(head)
        length = np.diff(at, append=len(sym))
        last = at + length - 1
        sym = np.where(length > 1, mix(sym[at] * _A + length.astype(np.uint64)), sym[at])
        lo, hi, doc = lo[at], hi[last], doc[at]
        lo, hi = _neighbours((lo, hi), doc, before, after)  # a run ends where its neighbours differ

        is_left = (mix(sym ^ mix(np.array([r + 1], dtype=np.uint64))) & np.uint64(1)) == 1
        pair = np.zeros(len(sym), dtype=bool)
        pair[:-1] = is_left[:-1] & ~is_left[1:] & (doc[1:] == doc[:-1])
        second = np.zeros(len(sym), dtype=bool)
        second[1:] = pair[:-1]
        near_lo, near_hi = _neighbours((lo, hi), doc, before, after)
        new_lo = np.where(is_left, lo, near_lo)
        new_hi = np.where(is_left, near_hi, hi)
        new_lo[pair] = lo[pair]
        names = sym.copy()
        i = np.flatnonzero(pair)
        names[i] = mix(sym[i] * _B + mix(sym[i + 1] + np.uint64(r)))
        stay = ~second
        sym, lo, hi, doc = names[stay], new_lo[stay], new_hi[stay], doc[stay]
    return sym, lo, hi, doc


def window_prints(h: np.ndarray) -> np.ndarray:
    """Fingerprints of WINDOW = 32 + 16 + 2 consecutive names from each place on (0 where none fits)."""
    out = np.zeros(len(h), dtype=np.uint64)
    n = len(h) - WINDOW + 1
    if n <= 0:
        return out
    size, g, parts = 1, h, {}
    while size < 32:
        g = mix(g[:-size] * _A + g[size:])
        size *= 2
        parts[size] = g
    out[:n] = mix(parts[32][:n] * _B + parts[16][32 : 32 + n] * _C + parts[2][48 : 48 + n])
    return out


def window_anchors(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all windows within documents, and the anchor of each."""
    n = np.diff(first)
    inside = np.repeat(np.maximum(first[1:] - WINDOW, -1), n)
    places = np.flatnonzero(np.arange(first[0], first[0] + len(h)) <= inside) if len(h) else np.zeros(0, dtype=np.int64)
    anchors = window_prints(h)[places]
    sym, lo, hi, doc = recompress(h, first)
    width = GRAM + GRAMS - 1
    m = len(sym) - width + 1
    if m <= 0 or not len(places):
        return places, anchors
    gram = sym[: len(sym) - GRAM + 1].copy()
    for k in range(1, GRAM):
        gram = gram * _C + sym[k : len(sym) - GRAM + 1 + k]
    gram = mix(gram)
    least = np.lib.stride_tricks.sliding_window_view(gram, GRAMS).min(axis=1)[:m]
    low, high = lo[:m], hi[width - 1 :][:m]
    whole = np.flatnonzero(doc[:m] == doc[width - 1 :][:m])
    # the first stretch that depends on no word before the window
    count = np.cumsum(np.bincount(np.maximum(low[whole] + 1, 0), minlength=len(h) + 2))
    at = count[places]
    known = at < len(whole)
    s = whole[np.minimum(at, len(whole) - 1)] if len(whole) else at
    if len(whole):
        fits = known & (high[s] < places + WINDOW) & (low[s] >= places)
        anchors[fits] = least[s[fits]]
    return places, anchors


def _names(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Names of the words of texts, and where each text's words begin."""
    _, _, h, first = words_of(texts)
    return h, first


def profiles(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_words, two fingerprints of the words, SHA-256 of the words joined by a space, and the distinct anchors."""
    bounded_batches(df.sparkSession)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = as_bytes(batch.column(1))
            for a, b in groups(texts):
                h, first = _names(texts[a:b])
                places, anchors = window_anchors(h, first)
                ends = np.searchsorted(places, first)
                digests = [sequence_digest(h[i:j]) for i, j in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(np.diff(first)),
                        pa.array([d[0] for d in digests], pa.int64()),
                        pa.array([d[1] for d in digests], pa.int64()),
                        pa.array([hashlib.sha256(b" ".join(t.split())).hexdigest() for t in texts[a:b]]),
                        pa.array([signed(np.unique(anchors[i:j])) for i, j in zip(ends[:-1], ends[1:], strict=True)], pa.list_(pa.int64())),
                    ],
                    names=["id", "n_words", "d1", "d2", "sha", "anchors"],
                )

    return df.select(F.col(key).cast("long").alias("id"), text).mapInArrow(run, "id long, n_words long, d1 long, d2 long, sha string, anchors array<long>")


def _windows(candidates: DataFrame) -> DataFrame:
    """(print, id, at) of the windows whose anchor is shared; candidates: id, text, shared."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids, texts, shared = batch.column(0).to_pylist(), as_bytes(batch.column(1)), batch.column(2)
            for i, t in enumerate(texts):
                h, first = _names([t])
                places, anchors = window_anchors(h, first)
                places = places[np.isin(anchors, shared[i].values.to_numpy().view(np.uint64))]
                prints = signed(window_prints(h)[places])
                for k in range(0, len(places), 100_000):
                    part = slice(k, k + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(prints[part]), pa.array(np.full(len(places[part]), ids[i], dtype=np.int64)), pa.array(places[part].astype(np.int32))], names=["print", "id", "at"])

    return candidates.select("id", "text", "shared").mapInArrow(run, "print long, id long, at int")


def repeats(df: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """What to remove: (id, n_words, sha, whole) a row for each of df; (id, starts) the windows to remove where a part goes; (id, text) of these and some more."""
    docs = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    every = cut(profiles(df, key, text))
    known = every.filter("id IS NOT NULL")
    reps = cut(known.filter(f"n_words >= {WINDOW}").groupBy("n_words", "d1", "d2").agg(F.min("id").alias("rep")))
    spread = known.select("id", "d1", F.explode("anchors").alias("anchor"))
    shared = cut(spread.groupBy("anchor").agg(F.min("d1").alias("lo"), F.max("d1").alias("hi"), F.count("*").alias("n")).filter("lo <> hi").select("anchor", "n"))
    rep_ids = reps.select(F.col("rep").alias("id")).distinct()
    # anchors and windows that very many texts hold go to several tasks
    hits = spread_join(spread.select("id", "anchor"), shared.select("anchor"), "anchor", "id", hot_keys(shared, "anchor", NARROW_ROWS, counts=shared))
    hits = hits.groupBy("id").agg(F.collect_set("anchor").alias("shared")).join(rep_ids, "id", "left_semi")
    candidates = cut(docs.join(hits, "id").dropDuplicates(["id"]))
    windows = cut(_windows(candidates))
    firsts = cut(windows.groupBy("print").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n")).filter("first < last").select("print", "first", "n"))
    later = spread_join(windows, firsts.select("print", "first"), "print", "id", hot_keys(firsts, "print", NARROW_ROWS, counts=firsts)).filter("id > first")
    starts = cut(later.groupBy("id").agg(F.sort_array(F.collect_set("at")).alias("starts")))
    drop(shared, windows, firsts)
    keyed = every.select("id", "n_words", "sha", "d1", "d2")
    same = ["n_words", "d1", "d2"]
    rows = spread_join(keyed, reps, same, "id", hot_keys(keyed, same, NARROW_ROWS), "left").select("id", "n_words", "sha", F.coalesce(F.col("id") > F.col("rep"), F.lit(False)).alias("whole"))
    return rows, starts, candidates.select("id", "text")


def keep_words(text: bytes, starts: np.ndarray) -> list[bytes]:
    """The words of a text that no window from one of the places covers."""
    found = text.split()
    change = np.zeros(len(found) + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + WINDOW, len(found)), -1)
    covered = np.cumsum(change)[:-1] > 0
    return [found[i] for i in np.flatnonzero(~covered)]


def digest(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_removed, kept_sha256."""
    rows, starts, texts = repeats(df, key, text)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            kept = [keep_words(t, s.values.to_numpy()) for t, s in zip(as_bytes(batch.column(1)), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(k) for k in kept], pa.int64()), pa.array([hashlib.sha256(b" ".join(k)).hexdigest() for k in kept])], names=["id", "n_kept", "part_sha"])

    parts = texts.join(starts, "id").select("id", "text", "starts").mapInArrow(run, "id long, n_kept long, part_sha string")
    nothing = hashlib.sha256(b"").hexdigest()
    out = rows.join(parts, "id", "left")
    return out.select(
        F.col("id").alias(key),
        "n_words",
        F.when(F.col("whole"), F.col("n_words")).otherwise(F.coalesce(F.col("n_words") - F.col("n_kept"), F.lit(0))).alias("n_removed"),
        F.when(F.col("whole"), F.lit(nothing)).otherwise(F.coalesce("part_sha", "sha")).alias("kept_sha256"),
    )


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df with the repeated words taken out; a text that loses some becomes its kept words joined by one space, others stay as they are."""
    rows, starts, _ = repeats(df, key, text)
    own, gone, at = fresh(df, "id", "whole", "starts")
    # written down, so that the join with the texts knows how small it is
    change = cut(rows.filter("whole AND id IS NOT NULL").select("id").distinct().withColumn("whole", F.lit(True)).join(starts, "id", "full")).toDF(own, gone, at)
    joined = df.join(change, F.col(key).cast("long") == F.col(own), "left").drop(own)
    names = df.columns
    place = names.index(text)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(place).to_pylist()
            whole, at = batch.column(len(names)).to_pylist(), batch.column(len(names) + 1)
            for i, t in enumerate(texts):
                if whole[i]:
                    texts[i] = ""
                elif at[i].is_valid:
                    texts[i] = b" ".join(keep_words((t or "").encode(), at[i].values.to_numpy())).decode()
            columns = [pa.array(texts, batch.schema.field(j).type) if j == place else batch.column(j) for j in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.select(*[F.col(f"`{c}`") for c in names], gone, at).mapInArrow(run, df.schema)
