"""What several operators share: the shared folder, bounded Arrow batches, and vectorised word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are worked on in groups of about so many bytes, so that numpy's scratch arrays stay small.
GROUP_BYTES = 1 << 20
#: A text longer than this is hashed in pieces that end at white space.
PIECE_BYTES = 4 << 20

#: A join's key with more rows than these (of a few numbers; of texts; of blocks that meet blocks), and than one in SHARE of all, is dealt to several tasks.
NARROW_ROWS, WIDE_ROWS, BLOCK_ROWS, SHARE = 10_000, 500, 8, 1000

_own_dirs: dict[str, str] = {}
_scratch: list[list[DataFrame]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir). A session in one process, as in tests, gets one of its own where none is set; on a cluster that is an error."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return _own_dirs[app]


@contextmanager
def released_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within, each write lets its shuffle files go when it ends: what it wrote is there to be read again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it again: lineage ends, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    with released_shuffles(spark):
        df.write.parquet(path)
    again = spark.read.schema(df.schema).parquet(path)
    again._cut_path = path
    for made in _scratch:
        made.append(again)
    return again


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that cut() writes within are deleted at the end, when what they were for is written."""
    made: list[DataFrame] = []
    _scratch.append(made)
    try:
        yield
    finally:
        _scratch.remove(made)
        drop(*made)


def drop(*tables: DataFrame | None) -> None:
    """Delete tables that cut() wrote and that nothing reads any more."""
    for df in tables:
        if df is not None and hasattr(df, "_cut_path"):
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._cut_path)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def hot_keys(table: DataFrame, on: str | list[str], least: int, counts: DataFrame | None = None) -> DataFrame | None:
    """(keys, _parts): the keys with more than least rows, and more than one in SHARE of all, and to how many tasks to deal them; None if there are none.

    table was written by cut(); counts, if given, has its keys and their numbers of rows, n. There are fewer than SHARE hot keys, however many rows, so their list is bounded.
    """
    keys = [on] if isinstance(on, str) else on
    total = table.count() if counts is None else counts.agg(F.sum("n")).first()[0] or 0
    if total <= least:
        return None
    per = max(least, total // SHARE)
    counts = table.groupBy(*keys).agg(F.count("*").alias("n")) if counts is None else counts
    hot = counts.filter(F.col("n") > per).select(*keys, F.ceil(F.col("n") / per).cast("int").alias("_parts"))
    rows = hot.collect()
    return table.sparkSession.createDataFrame(rows, hot.schema) if rows else None


def spread_join(left: DataFrame, right: DataFrame, on: str | list[str], by: str, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """left.join(right, on, how) (inner or left) in which no key fills a task: left's rows of hot keys are dealt by the column by, and right's rows of these keys repeated."""
    keys = [on] if isinstance(on, str) else on
    if hot is None:
        return left.join(right, keys, how)
    listed = F.broadcast(hot)  # fewer than SHARE rows
    dealt = left.join(listed, keys, "left").withColumn("_part", F.pmod(F.xxhash64(by), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    repeated = right.join(listed, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt.join(repeated, [*keys, "_part"], how).drop("_part")


def bounded_batches(spark: SparkSession) -> None:
    """Small Arrow batches, by rows and by bytes: the Python side holds one at a time, and a row may be a long document. Spark reads these settings when it plans, so they stay set in the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like those given that no column of df has, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def as_bytes(column) -> list[bytes]:
    """An Arrow string column as UTF-8 bytes; null is empty."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]


def groups(texts: list[bytes], limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of at most limit bytes together; a longer text is alone."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


_rng = np.random.RandomState(20240229)
_BYTE = _rng.randint(1, 2**63 - 1, size=256, dtype=np.int64).astype(np.uint64) | np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE[_SPACE] = 0
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_STEP = np.uint64(0x9E3779B97F4A7C15)
_power = np.ones(1, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    global _power
    if len(_power) < n:
        size = max(1024, 1 << (n - 1).bit_length())
        _power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _STEP, dtype=np.uint64)]), dtype=np.uint64)
    return _power


def _hash_piece(data: bytes, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    buf = np.frombuffer(data, dtype=np.uint8)
    space = _SPACE[buf]
    edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=np.int8(1), append=np.int8(1)))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return starts, ends, np.zeros(0, dtype=np.uint64)
    first = starts[0]
    pos = np.arange(first, len(buf)) - np.repeat(starts, np.diff(starts, append=len(buf)))
    longest = int((ends - starts).max())
    np.minimum(pos, longest, out=pos)
    terms = (_BYTE_LOWER if lower else _BYTE)[buf[first:]] * powers(longest + 1)[pos]
    return starts, ends, mix(np.add.reduceat(terms, starts - first))


def words(data: bytes, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte offsets where each word [^\\x20\\x09-\\x0D]+ starts and ends, and a 64-bit hash of its bytes (A-Z as a-z if lower)."""
    if len(data) <= PIECE_BYTES:
        return _hash_piece(data, lower)
    found, at = [], 0
    while at < len(data):
        end = min(len(data), at + PIECE_BYTES)
        if end < len(data):
            gap = max(data.rfind(bytes([c]), at, end) for c in (9, 10, 11, 12, 13, 32))
            if gap < 0:  # a word longer than a piece
                after = [x for c in (9, 10, 11, 12, 13, 32) if (x := data.find(bytes([c]), end)) >= 0]
                gap = min(after, default=len(data) - 1)
            end = gap + 1
        s, e, h = _hash_piece(data[at:end], lower)
        found.append((s + at, e + at, h))
        at = end
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def words_of(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of several texts, one after the other, and the index where each text's words begin (one more at the end); byte offsets are into the texts joined by a line feed."""
    starts, ends, hashes = words(b"\n".join(texts), lower)
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return starts, ends, hashes, np.searchsorted(starts, bounds)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def sequence_digest(hashes: np.ndarray) -> tuple[int, int]:
    """Two 64-bit fingerprints of a sequence of word hashes."""
    n = len(hashes)
    p = powers(n + 1)[:n]
    a = mix(np.array([(mix(hashes) * p).sum(dtype=np.uint64) + np.uint64(n)], dtype=np.uint64))
    b = mix(np.array([(mix(hashes ^ _STEP) * p[::-1]).sum(dtype=np.uint64) ^ np.uint64(n)], dtype=np.uint64))
    return int(signed(a)[0]), int(signed(b)[0])
