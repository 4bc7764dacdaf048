"""Quality classifier: a factorisation machine (operator 2).

A text becomes a sparse vector of hashed words (weighted by the logarithm of their
counts, unit length), of structure statistics, each as a one-hot bin, and of size
metadata in bins. Every pair of features interacts through RANK latent factors.
The score is linear in the number of features by the identity

    sum over pairs <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).

The model is fitted on at most TRAIN_ROWS labelled documents, those least by a hash
of their id among rows that are not held out; every text is scored whole. Labels,
lang, source and doc_id are no inputs.

Defined results: null and empty texts have features (size and zero counts) and get
a score; without labelled rows every score is 0.5; rows may repeat; a null doc_id is
hashed as the empty string; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bounded_batches, groups, mix, words_of

#: Bound of the training sample; a parameter, not a limit on scoring.
TRAIN_ROWS = 8000
WORD_BUCKETS, RANK = 1 << 14, 8
BINS = 12
EPOCHS, BATCH, RATE, DECAY = 12, 128, 0.05, 1e-5

_A = np.uint64(0x9FB21C651E98DF25)
_UPPER, _LOWER, _DIGIT, _SPACE, _LINE, _SYMBOL, _PUNCT, _OTHER = range(8)
_KIND = np.full(256, _OTHER, dtype=np.int64)
_KIND[33:127] = _PUNCT
_KIND[65:91], _KIND[97:123], _KIND[48:58] = _UPPER, _LOWER, _DIGIT
_KIND[[9, 11, 12, 13, 32]], _KIND[10] = _SPACE, _LINE
_KIND[[ord(c) for c in "#*$%&|<>@^~=+_\\{}[]"]] = _SYMBOL
#: Upper edges of the bins of shares, near zero finer; and of sizes, by powers of two.
_SHARES = np.array([0.0005, 0.002, 0.01, 0.02, 0.04, 0.08, 0.15, 0.25, 0.4, 0.6, 0.8])
_SIZES = 2.0 ** np.arange(2, 24, 2)
N_STATISTICS = 14
DIMENSIONS = WORD_BUCKETS + N_STATISTICS * BINS


def _repeated(keys: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """For each document, how many of its keys are equal to an earlier one."""
    if not len(keys):
        return np.zeros(n)
    order = np.lexsort((keys, doc))
    k, d = keys[order], doc[order]
    again = (k[1:] == k[:-1]) & (d[1:] == d[:-1])
    return np.bincount(d[1:][again], minlength=n).astype(np.float64)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: indices, values, and where each text's begin (one more at the end)."""
    n = len(texts)
    joined = b"\n".join(texts)
    starts, ends, h, first = words_of(texts, lower=True)
    n_words = np.diff(first).astype(np.float64)
    doc = np.repeat(np.arange(n), np.diff(first))
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    of_byte = np.repeat(np.arange(n), sizes + 1)[: len(joined)]
    counts = np.bincount(of_byte * 8 + _KIND[np.frombuffer(joined, dtype=np.uint8)], minlength=8 * n).reshape(n, 8).astype(np.float64)
    counts[: n - 1, _LINE] -= 1  # separators
    visible = np.maximum(1, counts[:, [_UPPER, _LOWER, _DIGIT, _SYMBOL, _PUNCT, _OTHER]].sum(axis=1))

    # words
    key, tf = np.unique(doc * WORD_BUCKETS + (h & np.uint64(WORD_BUCKETS - 1)).astype(np.int64), return_counts=True)
    owner = key // WORD_BUCKETS
    value = 1 + np.log(tf)
    length = np.sqrt(np.bincount(owner, weights=value * value, minlength=n))
    value = value / length[owner]

    # statistics
    per_word = np.maximum(1, n_words)
    next_doc = doc[1:] == doc[:-1]
    twice = np.bincount(doc[1:][next_doc & (h[1:] == h[:-1])], minlength=n)
    grams = h[:-4] if len(h) > 4 else h[:0]
    gram_doc = doc[:-4] if len(h) > 4 else doc[:0]
    if len(grams):
        inside = gram_doc == doc[4:]
        code = np.zeros(len(grams), dtype=np.uint64)
        for k in range(5):
            code = code * _A + h[k : len(h) - 4 + k]
        grams, gram_doc = code[inside], gram_doc[inside]
    width = np.bincount(doc, weights=(ends - starts).astype(np.float64), minlength=n)
    shares = np.stack(
        [
            counts[:, _UPPER] / visible,
            counts[:, _DIGIT] / visible,
            counts[:, _SYMBOL] / visible,
            counts[:, _PUNCT] / visible,
            counts[:, _OTHER] / visible,
            counts[:, _LINE] / per_word,
            twice / per_word,
            _repeated(h, doc, n) / per_word,
            _repeated(grams, gram_doc, n) / per_word,
            np.bincount(owner, weights=(tf == 1).astype(np.float64), minlength=n) / per_word,
            np.clip(width / per_word / 20, 0, 1),
        ],
        axis=1,
    )
    amounts = np.stack([n_words, sizes.astype(np.float64), counts[:, _LINE] + 1], axis=1)
    bins = np.concatenate([np.searchsorted(_SHARES, shares, side="left"), np.searchsorted(_SIZES, amounts, side="left")], axis=1)
    place = WORD_BUCKETS + np.arange(N_STATISTICS) * BINS + bins

    # words of a text, then its statistics
    n_own = np.bincount(owner, minlength=n)
    begin = np.concatenate([[0], np.cumsum(n_own + N_STATISTICS)])
    index, x = np.empty(begin[-1], dtype=np.int64), np.ones(begin[-1], dtype=np.float64)
    at = np.arange(len(key)) + owner * N_STATISTICS
    index[at], x[at] = key % WORD_BUCKETS, value
    tail = (begin[1:] - N_STATISTICS)[:, None] + np.arange(N_STATISTICS)
    index[tail] = place
    x[tail] = 0.5
    return index, x, begin


class Machine:
    """Bias, weights and factors."""

    def __init__(self):
        self.bias = 0.0
        self.w = np.zeros(DIMENSIONS)
        self.v = np.random.RandomState(5).normal(0, 0.02, (DIMENSIONS, RANK))

    def raw(self, index: np.ndarray, x: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores before the logistic function, and the sums of factors that the gradient needs."""
        vx = self.v[index] * x[:, None]
        sums = np.add.reduceat(vx, begin[:-1], axis=0)
        squares = np.add.reduceat((vx * vx).sum(axis=1), begin[:-1])
        return self.bias + np.add.reduceat(self.w[index] * x, begin[:-1]) + 0.5 * ((sums**2).sum(axis=1) - squares), sums, vx

    def score(self, index, x, begin) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(index, x, begin)[0], -30, 30)))

    def fit(self, index: np.ndarray, x: np.ndarray, begin: np.ndarray, y: np.ndarray) -> None:
        """Logistic loss, adaptive steps (AdaGrad), rows in a fixed random order."""
        rng = np.random.RandomState(9)
        share = np.clip(y.mean(), 0.01, 0.99)
        self.bias = float(np.log(share / (1 - share)))
        gw, gv, gb = np.full(DIMENSIONS, 1e-6), np.full((DIMENSIONS, RANK), 1e-6), 1e-6
        for _ in range(EPOCHS):
            order = rng.permutation(len(y))
            for k in range(0, len(y), BATCH):
                rows = order[k : k + BATCH]
                n = begin[rows + 1] - begin[rows]
                b = np.concatenate([[0], np.cumsum(n)])
                pick = np.arange(b[-1]) + np.repeat(begin[rows] - b[:-1], n)
                i, xi = index[pick], x[pick]
                raw, sums, vx = self.raw(i, xi, b)
                error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[rows]) / len(rows)
                each = np.repeat(error, n) * xi
                dv = each[:, None] * (sums[np.repeat(np.arange(len(rows)), n)] - vx)
                used, where = np.unique(i, return_inverse=True)
                dw = np.bincount(where, weights=each, minlength=len(used)) + DECAY * self.w[used]
                dvs = np.stack([np.bincount(where, weights=dv[:, f], minlength=len(used)) for f in range(RANK)], axis=1) + DECAY * self.v[used]
                gw[used] += dw**2
                gv[used] += dvs**2
                gb += error.sum() ** 2
                self.w[used] -= RATE * dw / np.sqrt(gw[used])
                self.v[used] -= RATE * dvs / np.sqrt(gv[used])
                self.bias -= RATE * error.sum() / np.sqrt(gb)


def held_out(key: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text") -> Machine | None:
    """Fitted on at most TRAIN_ROWS rows that are not held out; None without any."""
    bounded_batches(docs.sparkSession)
    rows = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(key)).groupBy(F.col(key).alias("_key")).agg(F.max(label).alias("_label"))
    sample = rows.orderBy(F.xxhash64("_key"), "_key").limit(TRAIN_ROWS)  # so many rows at most, thus broadcast
    joined = docs.join(F.broadcast(sample), F.col(key) == F.col("_key")).select("_key", text, "_label")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts, keys, y = as_bytes(batch.column(1)), batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for a, b in groups(texts):
                index, x, begin = features(texts[a:b])
                parts = [slice(i, j) for i, j in zip(begin[:-1], begin[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(keys[a:b], pa.int64()), pa.array(y[a:b], pa.float64()), pa.array([index[p].astype(np.int32).tobytes() for p in parts], pa.binary()), pa.array([x[p].astype(np.float32).tobytes() for p in parts], pa.binary())], names=["key", "y", "index", "x"])

    found = sorted(joined.mapInArrow(run, "key long, y double, index binary, x binary").collect(), key=lambda r: (r[0], bytes(r[2])))
    if not found:
        return None
    index = [np.frombuffer(r[2], dtype=np.int32).astype(np.int64) for r in found]
    machine = Machine()
    machine.fit(np.concatenate(index), np.concatenate([np.frombuffer(r[3], dtype=np.float32) for r in found]).astype(np.float64), np.concatenate([[0], np.cumsum([len(i) for i in index])]), np.array([r[1] for r in found]))
    return machine


def score(docs: DataFrame, machine: Machine | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, score, predicted."""
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(key), text, held_out(key).alias("held_out"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = as_bytes(batch.column(1))
            found = np.full(len(texts), 0.5)
            if machine is not None:
                for a, b in groups(texts):
                    found[a:b] = machine.score(*features(texts[a:b]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found), pa.array((found >= 0.5).astype(np.int32))], names=[key, "held_out", "score", "predicted"])

    return source.mapInArrow(run, f"{key} {source.schema[key].dataType.simpleString()}, held_out boolean, score double, predicted int")
