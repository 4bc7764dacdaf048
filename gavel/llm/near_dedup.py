"""Near-duplicate groups by fast similarity sketching (operator 4).

A document's set is its distinct five-word shingles. The sketch has BINS
coordinates. In each round every shingle is hashed anew, to a bin and a value
that grows with the round; a bin keeps its least value. After BINS rounds of
random bins, BINS more rounds visit one bin each, so every coordinate is filled
however small the set; a document stops once its bins are full. Two coordinates
agree with the probability of the sets' Jaccard similarity, with concentration as
for independent hashes.

Equal sets are one representative (their least doc_id). Sketches are banded, and of
buckets with the same members one stays. Within a bucket, representatives are
compared with a hub, not with each other: sketches first, then the full sets, made
from the texts of those pairs alone. Links make components; buckets that still hold
several components get other hubs. What remains of a bucket outside its largest
component is compared with all of the bucket in blocks within tasks: sketches say
which members have a partner, and only these members' full sets meet in blocks
again. So each pair that shares a bucket is linked, in one component already, or
checked; no bucket is capped, and no task holds more than a few blocks of a bucket.

Chances at similarity 0.75: no shared bucket, (1 - 0.75^4)^32 = 5e-6; sketches that
agree in less than LEAST_AGREEING coordinates, 1e-7.

Defined results: null and empty texts, and texts without words, have an empty set
and are linked with nothing; a text with one to four words is one shingle; a null
doc_id is linked with nothing and kept; repeated rows get the same result each; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLOCK_ROWS, NARROW_ROWS, WIDE_ROWS, as_bytes, bounded_batches, cut, drop, groups, hot_keys, mix, signed, spread_join, words_of

SHINGLE = 5
#: Least similarity of a link, as a fraction.
NUMERATOR, DENOMINATOR = 75, 100
BINS, BANDS = 128, 32
ROWS = BINS // BANDS
#: Rounds of hubs before the rest is compared in blocks of about BLOCK members and BLOCK_BYTES of sets.
HUB_ROUNDS, BLOCK, BLOCK_BYTES = 4, 64, 4 << 20
#: Sketches that agree in fewer coordinates are no candidates: 5 standard deviations below a similarity of 0.75.
LEAST_AGREEING = int(BINS * 0.56)

_SEEDS = mix(np.arange(1, 2 * BINS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_A = np.uint64(0x9FB21C651E98DF25)
_FULL = np.uint64(2**64 - 1)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    _, _, h, first = words_of(texts, lower=True)
    n = len(h)
    s = np.zeros(n, dtype=np.uint64)
    if n >= SHINGLE:
        whole = np.zeros(n - SHINGLE + 1, dtype=np.uint64)
        for k in range(SHINGLE):
            whole = whole * _A + h[k : n - SHINGLE + 1 + k]
        s[: len(whole)] = mix(whole)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(s[a : b - SHINGLE + 1]))
        elif b > a:
            out.append(mix(np.array([functools.reduce(lambda x, y: (x * int(_A) + y) % 2**64, h[a:b].tolist(), b - a)], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """BINS coordinates for each set; an empty set's are all ones."""
    found = np.full(len(sets) * BINS, _FULL, dtype=np.uint64)
    x = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    for r in range(2 * BINS):
        if not len(x):
            break
        h = mix(x ^ _SEEDS[r])
        bins = (h & np.uint64(BINS - 1)).astype(np.int64) if r < BINS else r - BINS
        np.minimum.at(found, owner * BINS + bins, np.uint64(r << 40) | (h >> np.uint64(24)))
        full = (found.reshape(-1, BINS) != _FULL).all(axis=1)
        stay = ~full[owner]
        x, owner = x[stay], owner[stay]
    return found.reshape(-1, BINS)


def sketches(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_shingles, two fingerprints of the set, bands (bucket keys) and the sketch (8 bits of each coordinate)."""
    bounded_batches(df.sparkSession)
    schema = "id long, n_shingles long, d1 long, d2 long, bands array<long>, sketch binary"

    def run(batches):
        import pyarrow as pa

        numbers = mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(77))
        for batch in batches:
            texts = as_bytes(batch.column(1))
            for a, b in groups(texts):
                sets = shingle_sets(texts[a:b])
                c = mix(sketch(sets))
                keys = np.zeros((len(sets), BANDS), dtype=np.uint64)
                for k in range(ROWS):
                    keys = mix(keys * _A + c[:, k::ROWS])
                keys = mix(keys ^ numbers)
                d1 = np.array([mix(s).sum(dtype=np.uint64) for s in sets], dtype=np.uint64)
                d2 = np.array([mix(s ^ _A).sum(dtype=np.uint64) for s in sets], dtype=np.uint64)
                short = (c & np.uint64(0xFF)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(signed(d1)),
                        pa.array(signed(d2)),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, len(sets) * BANDS + 1, BANDS, dtype=np.int32)), pa.array(signed(keys.reshape(-1)))),
                        pa.array([row.tobytes() for row in short], pa.binary()),
                    ],
                    names=["id", "n_shingles", "d1", "d2", "bands", "sketch"],
                )

    return df.select(F.col(key).cast("long").alias("id"), text).mapInArrow(run, schema)


def near_pairs(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Of pairs (a, b), a table of its own, those whose sketches may be those of linked sets, with the number of coordinates that agree."""
    own = reps.select("id", "sketch")
    both = spread_join(pairs.join(own.toDF("a", "_sa"), "a"), own.toDF("b", "_sb"), "b", "a", hot_keys(pairs, "b", NARROW_ROWS))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint8).reshape(-1, BINS) for k in (2, 3))
            agree = (one == two).sum(axis=1)
            keep = pa.array(agree >= LEAST_AGREEING)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(agree.astype(np.int32)).filter(keep)], names=["a", "b", "agree"])

    return both.select("a", "b", "_sa", "_sb").mapInArrow(run, "a long, b long, agree int")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of pairs (a, b), a table of its own with one hub b for each a, those linked, confirmed on the full sets of their texts (id, text). A text goes to its hub; those of a hot hub go to several tasks."""
    hubs = texts.join(pairs.select(F.col("b").alias("id")).distinct(), "id", "left_semi").toDF("b", "_tb")
    members = texts.toDF("a", "_ta").join(pairs, "a").select("a", "b", "_ta")
    both = spread_join(members, hubs, "b", "a", hot_keys(pairs, "b", WIDE_ROWS))

    def run(batches):
        import pyarrow as pa

        known: dict[int, np.ndarray] = {}  # sets of hubs; emptied when large
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ta, tb = as_bytes(batch.column(2)), as_bytes(batch.column(3))
            linked = []
            for i in range(len(a)):
                if b[i] not in known:
                    if sum(x.nbytes for x in known.values()) > 8 * BLOCK_BYTES:
                        known.clear()
                    known[b[i]] = shingle_sets([tb[i]])[0]
                linked.append(_linked(shingle_sets([ta[i]])[0], known[b[i]]))
            keep = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return both.select("a", "b", "_ta", "_tb").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(id, comp) for every end of an edge (a, b) and every id of known, components of earlier edges: the least id that can be reached.

    Earlier components count as one node each. Labels spread along edges and jump to their label's label until none changes.
    """
    if known is not None:
        of = known
        edges = edges.join(of.toDF("a", "_ca"), "a", "left").join(of.toDF("b", "_cb"), "b", "left").select(F.coalesce("_ca", "a").alias("a"), F.coalesce("_cb", "b").alias("b")).filter("a <> b")
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    hot = hot_keys(both, "b", NARROW_ROWS)
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("comp")))
    while True:
        near = spread_join(both, labels.withColumnRenamed("id", "b"), "b", "a", hot).groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("m"))
        hooked = labels.join(near, "id").select("id", F.least("comp", "m").alias("next"), F.col("comp").alias("was"))
        if hot is not None:
            hooked = cut(hooked)
        up = hooked.select(F.col("id").alias("next"), F.col("next").alias("m"))
        jumped = cut(spread_join(hooked, up, "next", "id", hot and hot_keys(hooked, "next", NARROW_ROWS), "left").select("id", F.least("next", "m").alias("comp"), "was"))
        drop(labels, hooked)
        labels = jumped.select("id", "comp")
        labels._cut_path = jumped._cut_path
        if jumped.filter("comp <> was").isEmpty():
            break
    drop(both)
    if known is None:
        return labels
    # an id's component is the new one of its earlier component, or of itself
    every = known.select("id").union(labels.select("id")).distinct().join(known, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    merged = cut(every.join(labels.toDF("comp", "m"), "comp", "left").select("id", F.coalesce("m", "comp").alias("comp")))
    drop(labels)
    return merged


def _with_components(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """members (key, id) with comp."""
    if labels is None:
        return members.withColumn("comp", F.col("id"))
    return members.join(labels, "id", "left").withColumn("comp", F.coalesce("comp", "id"))


def _sets(texts: DataFrame) -> DataFrame:
    """(id, shingles): the full sets as packed sorted hashes."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            own = as_bytes(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for a, b in groups(own) for s in shingle_sets(own[a:b])], pa.binary())], names=["id", "shingles"])

    return texts.select("id", "text").mapInArrow(run, "id long, shingles binary")


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    if not len(a) or not len(b) or min(len(a), len(b)) * DENOMINATOR < NUMERATOR * max(len(a), len(b)):
        return False
    common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return common > 0 and DENOMINATOR * common >= NUMERATOR * (len(a) + len(b) - common)


def _met_blocks(members: DataFrame, values: list[str], size: str, hot: DataFrame | None) -> DataFrame:
    """Blocks of each bucket's members outside its largest component, each beside every block of the bucket: key, largest, one, two.

    members: (key, id, comp, *values), a table of its own; size: the bytes of a row, in SQL; hot: the hot buckets. The blocks of such a bucket meet in several tasks.
    """
    per = members.groupBy("key", "comp").agg(F.count("*").alias("n"), F.sum(F.expr(size).cast("double")).alias("bytes"))
    per = per.groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("largest"), F.ceil(F.greatest(F.sum("n") / BLOCK, F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    d = spread_join(members, per, "key", "id", hot).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = F.collect_list(F.struct("id", "comp", *values))  # about BLOCK rows or BLOCK_BYTES
    blocks = cut(d.groupBy("key", "block").agg(F.first("largest").alias("largest"), rows.alias("members")).withColumn("rest", F.expr("filter(members, m -> m.comp <> largest)")))
    rest = blocks.filter("size(rest) > 0").select("key", "block", "largest", F.col("rest").alias("one"))
    return spread_join(rest, blocks.select("key", F.col("members").alias("two")), "key", "block", hot_keys(blocks, "key", BLOCK_ROWS)).select("key", "largest", "one", "two")


def _read(members) -> tuple[np.ndarray, np.ndarray, list[set], np.ndarray]:
    """id, comp, kept buckets and sketch of a block's members."""
    m = members.values
    return m.field(0).to_numpy(), m.field(1).to_numpy(), [set(x) for x in m.field(2).to_pylist()], np.frombuffer(b"".join(m.field(3).to_pylist()), dtype=np.uint8).reshape(-1, BINS)


def _near(i: int, one: tuple, two: tuple, largest: int, key: int) -> list[int]:
    """Members of block two that the i-th of block one may be linked with, most alike first; of two outside the largest component the lesser id asks, and a pair meets in the least of its buckets."""
    agree = (two[3] == one[3][i]).sum(axis=1)
    near = np.flatnonzero((two[1] != one[1][i]) & (agree >= LEAST_AGREEING) & ((two[1] == largest) | (two[0] > one[0][i])))
    return [int(j) for j in near[np.argsort(-agree[near], kind="stable")] if min(one[2][i] & two[2][j]) == key]


def _partners(mixed: DataFrame, hot: DataFrame | None) -> DataFrame:
    """(key, id) of the members of mixed buckets that may be linked with a member of another component; mixed: key, id, comp, keys, sketch."""

    def run(batches):
        import pyarrow as pa

        told = set()  # a member meets many blocks and is named once in a task
        for batch in batches:
            keys, ids = [], []
            for key, largest, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                one, two = _read(x), _read(y)
                found = set()
                for i in range(len(one[0])):
                    if near := _near(i, one, two, largest, key):
                        found.add(int(one[0][i]))
                        found.update(two[0][near].tolist())
                found = [i for i in found if (key, i) not in told]
                told.update((key, i) for i in found)
                keys += [key] * len(found)
                ids += found
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids, pa.int64())], names=["key", "id"])

    return _met_blocks(mixed, ["keys", "sketch"], "length(sketch)", hot).mapInArrow(run, "key long, id long").distinct()


def _in_blocks(asking: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Links (a, b) between members of different components; asking: key, id, comp, keys, sketch, shingles. Pairs that links found in the same task connect are passed over. Only links leave a task."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            left, right = [], []
            for key, largest, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                one, two = _read(x), _read(y)
                one_sets, two_sets = ([np.frombuffer(s, dtype=np.uint64) for s in m.values.field(4).to_pylist()] for m in (x, y))
                up: dict[int, int] = {}

                def root(c, up=up):
                    while up.get(c, c) != c:
                        c = up[c]
                    return c

                for i in range(len(one[0])):
                    for j in _near(i, one, two, largest, key):
                        a, b = root(int(one[1][i])), root(int(two[1][j]))
                        if a != b and _linked(one_sets[i], two_sets[j]):
                            up[max(a, b)] = min(a, b)
                            left.append(max(int(one[0][i]), int(two[0][j])))
                            right.append(min(int(one[0][i]), int(two[0][j])))
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return _met_blocks(asking, ["keys", "sketch", "shingles"], "length(shingles)", hot).mapInArrow(run, "a long, b long").distinct()


def _members(reps: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(key, id) of the buckets that several representatives share, and the hot ones; of buckets with the same members one."""
    spread = reps.select("id", F.explode("bands").alias("key"))
    counts = spread.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("who")).filter("n > 1")
    chosen = cut(counts.groupBy("n", "who").agg(F.min("key").alias("key")))
    hot = hot_keys(chosen, "key", NARROW_ROWS, counts=chosen.select("key", "n"))
    found = cut(spread_join(spread, chosen.select("key"), "key", "id", hot).select("key", "id"))
    drop(chosen)
    return found, hot


def _labels(reps: DataFrame, texts: DataFrame) -> DataFrame | None:
    """(id, comp) of the representatives that are linked with others; reps: id, bands, sketch; texts: all (id, text)."""
    members, hot = _members(reps)
    labels, tested = None, None
    for r in range(HUB_ROUNDS):
        held = _with_components(members, labels)
        order = F.col("id") if r == 0 else F.xxhash64("id", F.lit(r))
        hubs = held.groupBy("key").agg(F.min_by(F.struct("id", "comp"), order).alias("hub"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key", "hub")
        pairs = spread_join(held, hubs, "key", "id", hot).filter("comp <> hub.comp").select(F.col("id").alias("a"), F.col("hub.id").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested.union(tested.select("b", "a")), ["a", "b"], "left_anti")
        pairs = cut(pairs)
        # one hub a round for each member, the most alike, so the texts that move are no more than the members'
        best = cut(near_pairs(pairs, reps).groupBy("a").agg(F.max_by("b", F.struct("agree", "b")).alias("b")))
        asked = best.count()
        drop(pairs)
        if not asked:  # no new pair does not mean that no bucket is mixed
            break
        links = cut(verified(best, texts))
        found = links.count()
        if found:
            before = labels
            labels = components(links, before)
            drop(before, links)
        tested = best if tested is None else tested.union(best)
        if 10 * found < asked:
            break
    several = _with_components(members, labels).groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key")
    kept = members.groupBy("id").agg(F.collect_set("key").alias("keys"))  # BANDS at most
    mixed = cut(_with_components(spread_join(members, several, "key", "id", hot), labels).join(kept.join(reps.select("id", "sketch"), "id"), "id"))
    asking = cut(_partners(mixed, hot))
    if not asking.isEmpty():
        sets = _sets(texts.join(asking.select("id").distinct(), "id", "left_semi"))
        full = cut(mixed.join(asking, ["key", "id"], "left_semi").join(sets, "id"))
        links = cut(_in_blocks(full, hot))
        if not links.isEmpty():
            before = labels
            labels = components(links, before)
            drop(before)
        drop(full, links)
    drop(members, mixed, asking)
    return labels


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id (the least key that links reach), kept (key = component_id)."""
    texts = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    every = cut(sketches(texts, "id", "text").withColumn("row", F.monotonically_increasing_id()))
    usable = every.filter("n_shingles > 0 AND id IS NOT NULL")
    same = cut(usable.groupBy("n_shingles", "d1", "d2").agg(F.min(F.struct("id", "row")).alias("rep")).select("n_shingles", "d1", "d2", F.col("rep.id").alias("rep"), "rep.row"))
    reps = usable.join(same.groupBy("rep").agg(F.min("row").alias("row")).select("row"), "row", "left_semi").select("id", "bands", "sketch")
    labels = _labels(reps, texts)
    own = same.drop("row")
    if labels is not None:
        own = own.join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("rep", F.coalesce("comp", "rep")).drop("comp")
    keyed = every.select("id", "n_shingles", "d1", "d2")
    out = spread_join(keyed, own, ["n_shingles", "d1", "d2"], "id", hot_keys(keyed, ["n_shingles", "d1", "d2"], NARROW_ROWS), "left")
    return out.select(
        F.col("id").alias(key),
        "n_shingles",
        F.when(F.col("id").isNotNull(), F.coalesce("rep", "id")).alias("component_id"),
        (F.col("id").isNull() | F.col("rep").isNull() | (F.col("id") == F.col("rep"))).alias("kept"),
    )
