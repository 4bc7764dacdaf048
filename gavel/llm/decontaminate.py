"""Benchmark decontamination by latent semantic retrieval (operator 5).

Three scans of the documents. The first counts in how many passages (PASSAGE
consecutive words) each hashed term occurs, over all documents, for the inverse
document frequencies. The second is a randomised singular value decomposition of
the TF-IDF matrix whose rows are all passages of all documents and of the
benchmark, and whose columns are the benchmark's terms: with a random matrix O,
tasks sum up A'(A O), and the driver gets singular vectors from the small products
(Nystroem's method, one pass). The third slides windows over every text, projects
them, and takes those whose cosine with an item is large as candidates; words that
are no terms do not count in a window's length, and no term weighs less than
LEAST_IDF, so an item weighs the same however often the documents hold it. Places
that share MIN_WORDS consecutive words with an item are candidates without that. A
candidate is confirmed by the longest common subsequence of words with the item,
or a shorter one together with the item's answer, its last words.

Benchmark items are worked on in blocks of RANK, so that what tasks are sent is
bounded; each block takes its own second and third scan.

Defined results: null or empty texts and items match nothing; items of fewer than
MIN_WORDS words are found as whole sequences only; rows may repeat and are judged each; an empty
documents or benchmark table gives no matches; other columns are kept by clean and
ignored by matches.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, bounded_batches, groups, words_of

BUCKETS = 1 << 14
PASSAGE = 32
#: Singular vectors kept, and most items in a block.
RANK = 256
OVERSAMPLING = 8
#: Most words of a block's items together (an item with more is a block by itself), and most cells of a block's matrix: of more terms than BLOCK_WORDS fewer singular vectors are kept, in proportion.
BLOCK_WORDS = 1 << 14
CELLS = BLOCK_WORDS * (RANK + OVERSAMPLING)
MIN_WORDS = 8
LEAST_COSINE = 0.35
#: Words below this inverse document frequency (in more than one of 250 passages) are terms only as some of an item's rarest, RAREST or more; no term's weight is less.
LEAST_IDF, RAREST = 5.5, 8
#: A window with fewer words from the benchmark's terms is no candidate: an item has so many terms (or all its words) that LEAST_TERMS are left if only LCS_WITH_ANSWER of its words are there.
LEAST_TERMS = 3
#: Shares of an item's words in common order: enough alone, enough with the answer, and of the answer's own.
LCS_ALONE, LCS_WITH_ANSWER, ANSWER = 0.8, 0.6, 0.75
ANSWER_SHARE, ANSWER_WORDS = 0.2, 3
#: In the decomposition the items' rows together weigh so many times as much as all passages of documents.
ITEM_WEIGHT = 10.0
_A = np.uint64(0x9FB21C651E98DF25)
#: A table of so many bits says for a run of words whether an item may hold it.
RUN_BITS = 20


def bucket(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(BUCKETS - 1)).astype(np.int64)


def runs_of(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each word on."""
    out = np.zeros(max(0, len(h) - n + 1), dtype=np.uint64)
    for k in range(n):
        out = out * _A + h[k : len(h) - n + 1 + k] if len(out) else out
    return out


def row_sums(table: np.ndarray, rows: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each i the sum of table[rows[begin[i] : begin[i] + n[i]]], n being small; added in order, longest first so that each step is one slice."""
    order = np.argsort(-n, kind="stable")
    at = begin[order]
    left = np.cumsum(np.bincount(n, minlength=1)[::-1])[::-1]  # how many are of at least k rows
    out = np.zeros((len(n), table.shape[1]), dtype=table.dtype)
    for k in range(len(left) - 1):
        m = left[k + 1]
        out[:m] += table[rows[at[:m] + k]]
    back = np.empty(len(n), dtype=np.int64)
    back[order] = np.arange(len(n))
    return out[back]


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, bit-parallel: one addition of wide integers for each word of b."""
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        if m := places.get(y):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """For each hashed term the number of passages that hold it, and the number of passages, over all documents."""

    def run(batches):
        import pyarrow as pa

        counts = np.zeros(BUCKETS + 1, dtype=np.int64)
        for batch in batches:
            texts = as_bytes(batch.column(0))
            for a, b in groups(texts):
                _, _, h, first = words_of(texts[a:b], lower=True)
                passage = _passages(first)
                counts[:-1] += np.bincount(_distinct(passage * BUCKETS + bucket(h)) % BUCKETS, minlength=BUCKETS)
                counts[-1] += passage[-1] + 1 if len(passage) else 0
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["bucket", "n"])

    out = np.zeros(BUCKETS + 1, dtype=np.int64)
    for row in docs.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS + 1 rows at most
        out[row[0]] = row[1]
    return out[:-1], int(out[-1])


def _distinct(x: np.ndarray) -> np.ndarray:
    """np.unique, on narrow integers where they do."""
    if len(x) and x[-1] + BUCKETS < 2**31:  # passages are in order, so the last is the largest
        x = x.astype(np.int32)
    x.sort()
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _passages(first: np.ndarray) -> np.ndarray:
    """The passage of each word, numbered through."""
    n = np.diff(first)
    per = -(-n // PASSAGE)
    return np.repeat(np.cumsum(per) - per, n) + (np.arange(first[-1] - first[0]) - np.repeat(first[:-1] - first[0], n)) // PASSAGE


class Block:
    """Some items with their terms, weights and, once fitted, latent vectors; sent to tasks."""

    def __init__(self, items: list[tuple[int, bytes]], frequencies: np.ndarray, n_passages: int):
        self.idf = np.log((1 + n_passages) / (1 + frequencies)).clip(0).astype(np.float32)
        every = [(i, words_of([text], lower=True)[2]) for i, text in items]
        long, short = [x for x in every if len(x[1]) >= MIN_WORDS], [x for x in every if 0 < len(x[1]) < MIN_WORDS]
        self.words = [h for _, h in long]
        self.ids = [i for i, _ in long + short]
        own = [np.unique(w) for w in self.words]
        own = [w[np.argsort(-self.idf[bucket(w)], kind="stable")] for w in own]
        least = [max(RAREST, int(np.ceil((1 - LCS_WITH_ANSWER) * len(w))) + LEAST_TERMS) for w in self.words]
        self.terms = np.unique(np.concatenate([w[(self.idf[bucket(w)] >= LEAST_IDF) | (np.arange(len(w)) < n)] for w, n in zip(own, least, strict=True)])) if own else np.zeros(0, dtype=np.uint64)
        self.sets = [h.tolist() for _, h in long + short]
        self.weights = np.maximum(self.idf[bucket(self.terms)], np.float32(LEAST_IDF))
        # runs of words by their number: of long items every run of MIN_WORDS, of short ones the whole
        self.runs = []
        for n in range(1, MIN_WORDS + 1):
            held = [(j, runs_of(h, n)) for j, (_, h) in enumerate(long + short) if (len(h) == n if n < MIN_WORDS else len(h) >= n)]
            if held:
                run = np.concatenate([r for _, r in held])
                order = np.argsort(run, kind="stable")
                may = np.zeros(1 << RUN_BITS, dtype=bool)
                may[(run >> np.uint64(64 - RUN_BITS)).astype(np.int64)] = True
                self.runs.append((n, may, run[order], np.concatenate([np.full(len(r), j) for j, r in held])[order], np.concatenate([np.arange(len(r)) for _, r in held])[order]))
        # hash table of terms by their low bits, chained by slot order
        self.slots = 1 << max(12, int(4 * max(1, len(self.terms))).bit_length())
        slot = (self.terms % np.uint64(self.slots)).astype(np.int64)
        self.table = np.full(self.slots, -1, dtype=np.int32)
        self.table[slot[::-1]] = np.arange(len(self.terms), dtype=np.int32)[::-1]
        self.clash = bool(len(np.unique(slot)) < len(self.terms))
        sizes = [len(w) for w in self.words]
        self.classes, size, low = [], MIN_WORDS, 0
        while sizes and low < max(sizes):
            if own := [j for j, n in enumerate(sizes) if low < n <= size]:
                self.classes.append((size, own))
            low, size = size, -(-size * 3 // 8) * 4  # a multiple of four
        self.vectors = self.latent = None
        self.item_weight = np.sqrt(ITEM_WEIGHT * max(1, n_passages) / max(1, len(self.words)))

    def term_of(self, h: np.ndarray) -> np.ndarray:
        """The number of each word among the terms, or -1."""
        if not len(self.terms):
            return np.full(len(h), -1)
        if self.clash:
            near = self.table[(h % np.uint64(self.slots)).astype(np.int64)] >= 0
            out = np.full(len(h), -1, dtype=np.int64)
            at = np.searchsorted(self.terms, h[near]).clip(max=len(self.terms) - 1)
            out[near] = np.where(self.terms[at] == h[near], at, -1)
            return out
        at = self.table[(h % np.uint64(self.slots)).astype(np.int64)]
        return np.where((at >= 0) & (self.terms[at] == h), at, -1)

    def rows(self) -> np.ndarray:
        """Items as TF-IDF rows over the terms."""
        out = np.zeros((len(self.words), len(self.terms)))
        for j, h in enumerate(self.words):
            t = self.term_of(h)
            np.add.at(out[j], t[t >= 0], self.weights[t[t >= 0]])
        return out

    def fit(self, docs: DataFrame) -> None:
        m = len(self.terms)
        width = min(RANK + OVERSAMPLING, m, max(2 * OVERSAMPLING, CELLS // m))
        omega = np.random.RandomState(11).standard_normal((m, width)).astype(np.float32)
        block, weighted = self, omega * self.weights[:, None]

        def run(batches):
            import pyarrow as pa

            total = np.zeros((m, width), dtype=np.float64)
            for batch in batches:
                texts = as_bytes(batch.column(0))
                for a, b in groups(texts):
                    _, _, h, first = words_of(texts[a:b], lower=True)
                    t = block.term_of(h)
                    at = np.flatnonzero(t >= 0)
                    if not len(at):
                        continue
                    t, passage = t[at], _passages(first)[at]
                    head = np.flatnonzero(np.diff(passage, prepend=-1))
                    n = np.diff(head, append=len(t))
                    row = row_sums(weighted, t, head, n) / np.add.reduceat(block.weights[t] ** 2, head)[:, None]
                    order = np.argsort(t, kind="stable")
                    begin = np.flatnonzero(np.diff(t[order], prepend=-1))
                    term = t[order][begin]
                    total[term] += np.add.reduceat(row[np.repeat(np.arange(len(head)), n)[order]], begin, axis=0) * block.weights[term][:, None]
            seen = np.flatnonzero(total.any(axis=1))
            for k in range(0, len(seen), 1024):
                part = seen[k : k + 1024]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([x.tobytes() for x in total[part]], pa.binary())], names=["term", "sums"])

        def add(table):
            import pyarrow as pa

            sums = np.sum([np.frombuffer(x, dtype=np.float64) for x in table.column("sums").to_pylist()], axis=0)
            return pa.table({"term": table.column("term")[:1], "sums": pa.array([sums.tobytes()], pa.binary())})

        partial = docs.mapInArrow(run, "term long, sums binary")
        y = np.zeros((m, width))
        for row in partial.groupBy("term").applyInArrow(add, "term long, sums binary").toLocalIterator():  # a row for each term of the block
            y[row[0]] = np.frombuffer(row[1], dtype=np.float64)
        own = self.rows() * self.item_weight / np.maximum(1e-9, np.linalg.norm(self.rows(), axis=1, keepdims=True))
        y += own.T @ (own @ omega)
        c = omega.T.astype(np.float64) @ y
        c = (c + c.T) / 2
        values, vectors = np.linalg.eigh(c)
        good = values > values.max() * 1e-10
        u, _, _ = np.linalg.svd((y @ vectors[:, good]) / np.sqrt(values[good]), full_matrices=False)
        self.vectors = (u[:, :RANK] * self.weights[:, None]).astype(np.float32)  # weight included
        rows = self.rows()
        self.latent = ((rows @ u[:, :RANK]) / np.maximum(1e-9, np.linalg.norm(rows, axis=1, keepdims=True))).astype(np.float32)

    def search(self, h: np.ndarray, first: np.ndarray) -> list[list[tuple[int, float, float, float, int]]]:
        """For each of several texts, their words one after the other: (item, cosine, share of its words in common order, share of the answer's, first word of the window)."""
        n_docs = len(first) - 1
        out: list[dict[int, tuple]] = [{} for _ in range(n_docs)]
        t = self.term_of(h)
        active = np.flatnonzero(t >= 0)
        seen = t[active]
        energy = np.zeros(len(h) + 1)
        energy[1 + active] = self.weights[t[active]].astype(np.float64) ** 2
        energy = np.cumsum(energy)
        count = np.concatenate([[0], np.cumsum(t >= 0)])
        self.search_runs(h, first, t, energy, out)
        sizes = np.diff(first)
        for size, items in self.classes:
            step = size // 4
            per = np.where(sizes > 0, np.maximum(0, -(-(sizes - size) // step)) + 1, 0)
            doc = np.repeat(np.arange(n_docs), per)
            offset = np.cumsum(per) - per + 3 * np.arange(n_docs)  # of a text's steps, three more than its windows
            starts = first[doc] + step * (np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per))
            ends = np.minimum(starts + size, first[doc + 1])
            keep = np.flatnonzero(count[ends] - count[starts] >= LEAST_TERMS)
            latent = self.latent[items].T
            for k in range(0, len(keep), 2048):
                pick = keep[k : k + 2048]
                s, e, d = starts[pick], ends[pick], doc[pick]
                # a window is four steps: each step's sum is made once
                blocks, where = np.unique((pick + 3 * d)[:, None] + np.arange(4), return_inverse=True)
                block_doc = np.repeat(d, 4)[np.unique(where.ravel(), return_index=True)[1]]
                begin = np.minimum(first[block_doc] + step * (blocks - offset[block_doc]), first[block_doc + 1])
                lo, hi = count[begin], count[np.minimum(begin + step, first[block_doc + 1])]
                n = hi - lo
                sums = row_sums(self.vectors, seen, lo, n)
                where = where.reshape(-1, 4)
                z = sums[where[:, 0]]
                for quarter in range(1, 4):
                    z += sums[where[:, quarter]]
                cosine = z @ latent / np.sqrt(energy[e] - energy[s])[:, None]
                for i, j in zip(*np.nonzero(cosine >= LEAST_COSINE), strict=True):
                    item, c, x, mine = items[j], float(cosine[i, j]), d[i], out[d[i]]
                    if mine.get(item, ())[:2] == (1.0, 1.0):
                        continue
                    found = self.confirm(item, h, max(int(first[x]), int(s[i]) - size // 2), min(int(first[x + 1]), int(e[i]) + size // 2))
                    if found and (*found, c) > mine.get(item, ())[:3]:
                        mine[item] = (*found, c, int(s[i] - first[x]))
        return [[(self.ids[item], c, share, answer, at) for item, (share, answer, c, at) in sorted(x.items())] for x in out]

    def search_runs(self, h: np.ndarray, first: np.ndarray, t: np.ndarray, energy: np.ndarray, out: list[dict[int, tuple]]) -> None:
        """Add to out what is confirmed where a text and an item share a run of words."""
        for n, may, known, items, offsets in self.runs:
            run = runs_of(h, n)
            at = np.flatnonzero(may[(run >> np.uint64(64 - RUN_BITS)).astype(np.int64)])
            lo, hi = np.searchsorted(known, run[at]), np.searchsorted(known, run[at], side="right")
            doc = np.searchsorted(first, at, side="right") - 1
            good = (hi > lo) & (at + n <= first[doc + 1])
            at, lo, doc, m = at[good], lo[good], doc[good], (hi - lo)[good]
            which = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(lo, m)
            at, doc, item = np.repeat(at, m), np.repeat(doc, m), items[which]
            start = at - offsets[which]
            length = np.array([len(x) for x in self.sets], dtype=np.int64)[item]
            # one place for each quarter of an item; a short item's first is enough
            place = np.stack([doc, item, start // np.maximum(1, length // 4) if n == MIN_WORDS else np.zeros_like(start)])
            for i in np.sort(np.unique(place, axis=1, return_index=True)[1]).tolist():
                x, j, size, mine = int(doc[i]), int(item[i]), int(length[i]), out[doc[i]]
                if mine.get(j, ())[:2] == (1.0, 1.0):
                    continue
                s, e = max(int(first[x]), int(start[i])), min(int(first[x + 1]), int(start[i]) + size)
                if n < MIN_WORDS:
                    if h[s:e].tolist() == self.sets[j]:
                        mine[j] = (1.0, 1.0, 1.0, s - int(first[x]))
                    continue
                found = self.confirm(j, h, max(int(first[x]), s - size // 2), min(int(first[x + 1]), e + size // 2))
                if found:
                    own = t[s:e]
                    c = float(self.vectors[own[own >= 0]].sum(axis=0) @ self.latent[j] / np.sqrt(max(1e-9, energy[e] - energy[s])))
                    if (*found, c) > mine.get(j, ())[:3]:
                        mine[j] = (*found, c, s - int(first[x]))

    def confirm(self, item: int, h: np.ndarray, start: int, end: int) -> tuple[float, float] | None:
        a, b = self.sets[item], h[start:end].tolist()
        there = set(b)
        if sum(x in there for x in a) < LCS_WITH_ANSWER * len(a):
            return None
        share = lcs(a, b) / len(a)
        if share < LCS_WITH_ANSWER:
            return None
        tail = a[-max(ANSWER_WORDS, int(ANSWER_SHARE * len(a))) :]
        answer = lcs(tail, b) / len(tail)
        return (share, answer) if share >= LCS_ALONE or answer >= ANSWER else None


def blocks(docs: DataFrame, benchmark: DataFrame, text: str, item: str, item_text: str) -> list[Block]:
    """Fitted blocks of the benchmark. The benchmark is the stated query set: items come to the driver a block at a time, RANK items or BLOCK_WORDS words, so that what a task holds of a block is bounded however long its items are."""
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(text).alias("text"))
    frequencies, n = document_frequencies(source)
    out, pending, size = [], [], 0
    for row in benchmark.select(F.col(item).cast("long"), item_text).filter(F.col(item_text).isNotNull()).orderBy(item, item_text).toLocalIterator():
        encoded = row[1].encode()
        words = len(encoded.split())
        if pending and (len(pending) == RANK or size + words > BLOCK_WORDS):
            out.append(Block(pending, frequencies, n))
            pending, size = [], 0
        pending.append((row[0], encoded))
        size += words
    if pending:
        out.append(Block(pending, frequencies, n))
    out = [b for b in out if b.ids]
    for b in out:
        if len(b.terms):
            b.fit(source)
    return out


def _found(block: Block, texts: list[bytes]) -> list[list]:
    out = []
    for a, b in groups(texts):
        _, _, h, first = words_of(texts[a:b], lower=True)
        out += block.search(h, first)
    return out


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each document and each item it holds: key, item, cosine, lcs_share, answer_share, at_word, contaminated (true)."""
    source = docs.select(F.col(key).cast("long").alias(key), text)
    schema = T.StructType(
        [T.StructField(key, T.LongType()), T.StructField(item, T.LongType()), T.StructField("cosine", T.DoubleType()), T.StructField("lcs_share", T.DoubleType()), T.StructField("answer_share", T.DoubleType()), T.StructField("at_word", T.LongType()), T.StructField("contaminated", T.BooleanType())]
    )
    parts = []
    for block in blocks(docs, benchmark, text, item, item_text):

        def run(batches, block=block):
            import pyarrow as pa

            for batch in batches:
                ids = batch.column(0).to_pylist()
                rows = [(ids[i], f[0], round(f[1], 6), round(f[2], 6), round(f[3], 6), f[4], True) for i, found in enumerate(_found(block, as_bytes(batch.column(1)))) for f in found]
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=pa.schema([(key, pa.int64()), (item, pa.int64()), ("cosine", pa.float64()), ("lcs_share", pa.float64()), ("answer_share", pa.float64()), ("at_word", pa.int64()), ("contaminated", pa.bool_())]))

        parts.append(source.mapInArrow(run, schema))
    return functools.reduce(DataFrame.union, parts) if parts else docs.sparkSession.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without the documents that hold a benchmark item."""
    out = docs
    for block in blocks(docs, benchmark, text, item, item_text):

        def run(batches, block=block, place=docs.columns.index(text)):
            import pyarrow as pa

            for batch in batches:
                yield batch.filter(pa.array([not f for f in _found(block, as_bytes(batch.column(place)))], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out
