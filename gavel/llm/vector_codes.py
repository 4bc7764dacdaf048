"""Compression of vectors to codes by parts, with memoised grid cells (operator 12).

A vector of integers floor(scale * x) is cut into equal consecutive parts; each
part position has a codebook that starts with the parts of the least keys and is
moved to its parts' floored means in a number of rounds. Every round is a Spark
job over a written table: tasks assign parts and give back counts and sums for each
entry, so the driver sees as many rows as there are entries.

The nearest entry is found by a grid: a part falls in a coarse cell, and for each
cell a task remembers which entries can be nearest to some point of the cell's box:
those whose least distance to the box is not over the smallest of all entries'
greatest distances. Only these are evaluated, exactly, ties to the lower index;
the others are farther than some entry from every point of the box. A task holds at
most CELLS cells of a part position and forgets them when there are more.

Defined results: a row whose vector is null, empty or holds a null, a NaN or an
infinite component is dropped; the length of vectors is that of the least key's
kept one unless given, and rows of another length are dropped too; a component
beyond LIMIT after scaling counts as LIMIT, so that all sums fit 64 bits; a null
key comes after all others; rows that repeat a key are rows of their own, in the
order of their vectors when the codebook starts; fewer rows than entries give
fewer entries; null labels are one label; a label's error over 64 bits is null; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, hot_keys, spread_join

#: Components are held within this many either way.
LIMIT = 1 << 26
#: Cells that a task remembers for each part position, and cells to a side of the codebook's first extent.
CELLS, SIDE = 1 << 16, 4


def integers(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 4096, length: int | None = None) -> DataFrame:
    """key, label and v, the kept rows' integer vectors, as a written table."""
    rows = vectors.select(F.col(key).alias("key"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("_v"))
    finite = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    held = F.transform("_v", lambda x: F.floor(F.greatest(F.lit(-1.0 * LIMIT), F.least(F.lit(1.0 * LIMIT), x * scale))).cast("int"))
    table = cut(rows.filter((F.size("_v") > 0) & finite).select("key", "label", held.alias("v")))
    if length is None:
        first = table.orderBy(F.asc_nulls_last("key"), "v").select(F.size("v").alias("n")).first()
        length = first.n if first else 0
    return table.filter(F.size("v") == length)


class Cells:
    """The candidates of each cell of one part position; codebook is (entries, width)."""

    def __init__(self, codebook: np.ndarray, side: int):
        self.codebook, self.side, self.known = codebook, side, {}

    def _candidates(self, cells: np.ndarray) -> np.ndarray:
        """Which entries may be nearest to a point of each box [cell * side, cell * side + side - 1]."""
        low = cells[:, None, :] * self.side
        gap = np.maximum(np.maximum(low - self.codebook, self.codebook - (low + self.side - 1)), 0)
        far = np.maximum(np.abs(self.codebook - low), np.abs(self.codebook - (low + self.side - 1)))
        least, greatest = (gap * gap).sum(2), (far * far).sum(2)
        return least <= greatest.min(1)[:, None]

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry and squared distance for each row of parts (rows, width)."""
        cells = np.ascontiguousarray(parts // self.side)
        name = cells.view(np.dtype((np.void, cells.dtype.itemsize * cells.shape[1]))).ravel()
        _, first, which = np.unique(name, return_index=True, return_inverse=True)
        keys = [name[i].tobytes() for i in first]
        new = [i for i, k in enumerate(keys) if k not in self.known]
        if len(self.known) + len(new) > CELLS:
            self.known, new = {}, list(range(len(keys)))
        if new:
            self.known.update(zip([keys[i] for i in new], self._candidates(cells[first[new]]), strict=True))
        allowed = np.stack([self.known[k] for k in keys])[which]
        row, entry = np.nonzero(allowed)
        away = parts[row] - self.codebook[entry]
        away = (away * away).sum(1)
        begin = np.searchsorted(row, np.arange(len(parts)))
        least = np.minimum.reduceat(away, begin)
        hit = np.flatnonzero(away == least[row])
        _, leading = np.unique(row[hit], return_index=True)  # the lowest entry of those at the least distance
        return entry[hit[leading]], least


def _parts(column, parts: int) -> np.ndarray:
    """(rows, parts, width) of an Arrow column of equally long lists."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), parts, -1)


def _memory(codebooks: list[np.ndarray], sides: list[int]) -> list[Cells]:
    return [Cells(c, s) for c, s in zip(codebooks, sides, strict=True)]


def first_codebooks(table: DataFrame, parts: int, entries: int) -> list[np.ndarray]:
    rows = table.orderBy(F.asc_nulls_last("key"), "v").limit(entries).select("v").collect()
    whole = np.array([r.v for r in rows], dtype=np.int64)
    if not len(whole):
        return []
    if whole.shape[1] % parts:
        raise ValueError(f"vectors of {whole.shape[1]} components have no {parts} equal parts")
    return list(np.ascontiguousarray(whole.reshape(len(whole), parts, -1).transpose(1, 0, 2)))


def _sides(codebooks: list[np.ndarray]) -> list[int]:
    return [max(1, int(c.max() - c.min() + 1) // SIDE) for c in codebooks]


def next_codebooks(table: DataFrame, codebooks: list[np.ndarray], sides: list[int]) -> list[np.ndarray]:
    """One round: each entry becomes the floored mean of the parts nearest to it."""
    parts, entries, width = len(codebooks), *codebooks[0].shape

    def gather(batches):
        import pyarrow as pa

        memory = _memory(codebooks, sides)
        counts, sums = np.zeros((parts, entries), dtype=np.int64), np.zeros((parts, entries, width), dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                values = _parts(batch.column(0), parts)
                for p in range(parts):
                    found, _ = memory[p].nearest(values[:, p])
                    counts[p] += np.bincount(found, minlength=entries)
                    np.add.at(sums[p], found, values[:, p])
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(counts[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))],
            ["part", "entry", "n", "sums"],
        )

    made = table.select("v").mapInArrow(gather, "part int, entry int, n long, sums array<long>")
    added = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
    out = [c.copy() for c in codebooks]
    for r in made.groupBy("part", "entry").agg(F.sum("n").alias("n"), *added).collect():  # a row for each entry
        out[r.part][r.entry] = [int(r[f"s{i}"]) // r.n for i in range(width)]
    return out


def encode(table: DataFrame, codebooks: list[np.ndarray], sides: list[int]) -> DataFrame:
    """key, label, code (two hex digits for each part) and error of every row of a table of integer vectors."""
    parts = len(codebooks)
    schema = table.select("key", "label").schema.add("code", "string").add("error", "long")

    def assign(batches: Iterator):
        import pyarrow as pa

        memory = _memory(codebooks, sides)
        digits = np.array([f"{i:02x}" for i in range(256)])
        for batch in batches:
            if batch.num_rows:
                values = _parts(batch.column(2), parts)
                found = [memory[p].nearest(values[:, p]) for p in range(parts)]
                codes = digits[np.stack([f for f, _ in found], 1)]
                error = np.sum([e for _, e in found], axis=0)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(["".join(c) for c in codes.tolist()]), pa.array(error)], ["key", "label", "code", "error"])

    return table.select("key", "label", "v").mapInArrow(assign, schema)


def codebook_digest(codebooks: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for c in codebooks for x in c.ravel()).encode()).hexdigest()


def train(table: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6) -> tuple[list[np.ndarray], list[int]]:
    """Codebooks after the rounds, and the sides of each part position's cells; none for an empty table."""
    if entries > 256:
        raise ValueError("an index has two hex digits, so a codebook at most 256 entries")
    bounded_batches(table.sparkSession)
    codebooks = first_codebooks(table, parts, entries)
    sides = _sides(codebooks)
    for _ in range(rounds if codebooks else 0):
        codebooks = next_codebooks(table, codebooks, sides)
    return codebooks, sides


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, length: int | None = None) -> DataFrame:
    """key, code, error, label_error and codebooks_sha256 of every kept row."""
    table = integers(vectors, key, vector, label, scale, length)
    codebooks, sides = train(table, parts, entries, rounds)
    if not codebooks:
        out = table.select(F.col("key").alias(key), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(None).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
        return out.limit(0)
    coded = cut(encode(table, codebooks, sides).select("key", F.col("label").isNull().alias("_none"), F.coalesce("label", F.lit("")).alias("_label"), "code", "error"))
    sums = cut(coded.groupBy("_none", "_label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("_sum"), F.count("*").alias("n")))
    both = spread_join(coded, sums.drop("n"), ["_none", "_label"], "key", hot_keys(coded, ["_none", "_label"], 10_000, sums))
    return both.select(F.col("key").alias(key), "code", "error", F.expr("try_cast(_sum AS BIGINT)").alias("label_error"), F.lit(codebook_digest(codebooks)).alias("codebooks_sha256"))


def decode(coded: DataFrame, codebooks: list[np.ndarray], code: str = "code") -> DataFrame:
    """coded with v, the vector of integers that each code stands for."""
    flat = F.array(*[F.array(*[F.array(*[F.lit(int(x)) for x in entry]) for entry in book]) for book in codebooks])
    index = F.transform(F.sequence(F.lit(0), F.lit(len(codebooks) - 1)), lambda p: F.conv(F.substring(F.col(code), p * 2 + 1, 2), 16, 10).cast("int"))
    return coded.withColumn("v", F.flatten(F.transform(index, lambda e, p: F.element_at(F.element_at(flat, p + 1), e + 1))))
