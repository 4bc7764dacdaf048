"""Relatedness graph, components, lineage, and vector neighbours."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gavel.plans.tables import LEAST, checkpointed, drop, hot_keys, spread_join

def related_edges(catalog: DataFrame, least_confidence: float = 0.5, mutual_only: bool = False) -> DataFrame:
    """a, b, confidence: undirected edges of related ids that exist; 1.0 if both name each other, else 0.5. A catalog that names itself is its own mutual neighbour."""
    raw = catalog.select(F.col("id").alias("src"), F.explode("related_ids").alias("r")).select("src", F.col("r").try_cast("long").alias("dst")).filter("dst IS NOT NULL").distinct()
    raw = raw.join(catalog.select(F.col("id").alias("dst")), "dst", "left_semi")
    pair = raw.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), (F.col("src") <= F.col("dst")).alias("up"))
    both = pair.groupBy("a", "b").agg(F.when((F.count_distinct("up") == 2) | (F.col("a") == F.col("b")), 1.0).otherwise(0.5).alias("confidence"))
    return both.filter((F.col("confidence") >= least_confidence) & (F.lit(not mutual_only) | (F.col("confidence") == 1.0)))


def _roots(links: DataFrame, least: int) -> DataFrame:
    """id, root of every node of links (a, b, both ways), a written table: each node hangs on its least neighbour if that is less, and pointers jump to the top."""
    found = checkpointed(links.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("root"), F.lit(True).alias("moved")))
    while not found.filter("moved").isEmpty():
        up = found.select(F.col("id").alias("root"), F.col("root").alias("higher"))
        jumped = spread_join(found.select("id", "root"), up, "root", "id", hot_keys(found, "root", least))
        jumped = checkpointed(jumped.select("id", F.col("higher").alias("root"), (F.col("higher") != F.col("root")).alias("moved")))
        drop(found)
        found = jumped
    return found


def components(nodes: DataFrame, edges: DataFrame, least: int = LEAST) -> DataFrame:
    """id, component: the least id that edges (a, b) reach.

    A round contracts the graph: nodes become the roots that they hang on, and only links between roots are left, fewer than half the nodes of the round
    before. Rows of a node or root with more than least links, and more than a thousandth of all, are dealt to several tasks, so a star's centre fills none.
    Tables of earlier rounds are deleted.
    """
    links = checkpointed(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct())
    labels = checkpointed(nodes.select("id", F.col("id").alias("component")))
    while not links.isEmpty():
        roots = _roots(links, least)
        hot = hot_keys(links, "a", least)  # links go both ways, so b has the same hot nodes
        a, b = (roots.select(F.col("id").alias(end), F.col("root").alias(f"root_{end}")) for end in "ab")
        half = spread_join(links, a, "a", "b", hot).select("root_a", "b")
        whole = spread_join(half, b, "b", "root_a", hot.withColumnRenamed("a", "b") if hot is not None else None)
        left = checkpointed(whole.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).filter("a <> b").distinct())
        up = roots.select(F.col("id").alias("component"), "root")
        moved = spread_join(labels, up, "component", "id", hot_keys(labels, "component", least), "left")
        moved = checkpointed(moved.select("id", F.coalesce("root", "component").alias("component")))
        drop(links, roots, labels)
        links, labels = left, moved
    drop(links)
    return labels


def lineage(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """catalog_id, lineage_id, confidence, size, degree: confidence from a component's size and a node's degree."""
    found = components(nodes, edges)
    sizes = found.groupBy("component").agg(F.count("*").alias("size"))
    ends = edges.select(F.col("a").alias("id"), F.col("b").alias("n")).union(edges.select("b", "a")).distinct().groupBy("id").agg(F.count("*").alias("degree"))
    d = found.join(sizes, "component").join(ends, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    value = F.least(F.lit(1.0), 0.3 + 0.2 * F.least("degree", F.lit(3)) + 0.1 * F.least(F.col("size") - 1, F.lit(5)))
    return d.select(F.col("id").alias("catalog_id"), F.concat(F.lit("lin-"), F.col("component").cast("string")).alias("lineage_id"), F.when(F.col("size") <= 1, 0.2).otherwise(F.round(value, 3)).alias("confidence"), "size", "degree")


def _matrix(block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, vectors of length 1 and floors of a block of _packed."""
    ids, x, floor = (np.frombuffer(block[n].as_buffer(), t) for n, t in (("ids", np.int64), ("x", np.float64), ("floor", np.float64)))
    return ids, x.reshape(len(ids), -1), floor


def _packed(blocks: DataFrame, k: int = 0, least: float = 0.0) -> DataFrame:
    """blocks with rows, lists of (id, vector), as a struct of bytes: ids, x (vectors of length 1) and floor. A block that many others meet is normed once and moves as it is.

    Where k is given, a row's floor is the score of its k-th best in its own block: in no other block need it look for less. Without, rows have none.
    """
    keys = [c for c in blocks.columns if c != "rows"]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                v = batch.column(len(keys))[i].values
                ids, x = v.field(0).to_numpy().astype(np.int64), _normed(v.field(1))
                floor = np.full(len(ids), -np.inf)
                if k:
                    own = _Best(ids, x, floor, k, least)
                    own.meet(ids, x)
                    floor = own.score[:, -1]
                cells = [pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for a in (ids, x, floor)]
                packed = pa.StructArray.from_arrays(cells, names=["ids", "x", "floor"])
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(i, 1) for k in range(len(keys))] + [packed], names=[*keys, "rows"])

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocks.select(*keys).schema)
    return blocks.select(*keys, "rows").mapInArrow(run, f"{kind}, rows struct<ids:binary,x:binary,floor:binary>")


def _normed(column) -> np.ndarray:
    """A row of length 1 for each vector of an Arrow column or list."""
    if hasattr(column, "flatten") and not column.null_count and len(column):
        x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    else:
        x = np.array(column.to_pylist() if hasattr(column, "to_pylist") else column, dtype=np.float64)
    return x / np.maximum(1e-12, np.linalg.norm(x, axis=1, keepdims=True)) if len(x) else x


#: Rows of a block, and of another, that are compared at once: their products fit into a core's cache.
TILE, WIDE = 256, 2048


def _places(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.nonzero of a matrix in which few places are true: eight are looked at as one number."""
    flat = flags.ravel()
    if flat.size % 8:
        return np.nonzero(flags)
    some = np.flatnonzero(flat.view(np.uint64))
    word, bit = np.nonzero(flat.reshape(-1, 8)[some])
    return np.divmod(some[word] * 8 + bit, flags.shape[1])


class _Best:
    """The k best neighbours of a block's rows so far.

    A product in single precision, with its error allowed for, tells which pairs may be among a row's k best; those are scored in double precision.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, floor: np.ndarray, k: int, least: float):
        self.ids, self.x, self.floor, self.k, self.least = ids, x, np.maximum(floor, least), k, least
        self.single = x.astype(np.float32)
        self.error = 1e-9 + (x.shape[1] + 8) * 1.2e-7
        self.score, self.neighbour = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)

    def meet(self, b: np.ndarray, y: np.ndarray) -> None:
        for to in range(0, len(b), WIDE):
            self._meet(b[to : to + WIDE], y[to : to + WIDE])

    def _meet(self, b: np.ndarray, y: np.ndarray) -> None:
        other = np.ascontiguousarray(y.astype(np.float32).T)
        for at in range(0, len(self.ids), TILE):
            ids, s = self.ids[at : at + TILE], self.single[at : at + TILE] @ other
            floor = np.maximum(self.score[at : at + TILE, -1], self.floor[at : at + TILE])
            may = s >= (floor - self.error).astype(np.float32)[:, None]
            if np.count_nonzero(may) > 16 * self.k * len(ids) and s.shape[1] > self.k:  # many: only those near each row's k-th
                s[ids[:, None] == b[None, :]] = -2
                kth = np.partition(s, s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k]
                may &= s >= (kth - 2 * self.error).astype(np.float32)[:, None]
            r, c = _places(may)
            if not len(r):
                continue
            score = np.round(np.einsum("ij,ij->i", self.x[at + r], y[c]), 9)
            fit = (ids[r] != b[c]) & (score >= self.least)
            if fit.any():
                self._add(at + r[fit], score[fit], b[c[fit]])

    def _add(self, r: np.ndarray, score: np.ndarray, neighbour: np.ndarray) -> None:
        rows = np.unique(r)
        r = np.concatenate([r, np.repeat(rows, self.k)])
        score, neighbour = np.concatenate([score, self.score[rows].ravel()]), np.concatenate([neighbour, self.neighbour[rows].ravel()])
        order = np.lexsort((neighbour, -score, r))
        r, score, neighbour = r[order], score[order], neighbour[order]
        rank = np.arange(len(r)) - np.searchsorted(r, r)
        first = rank < self.k
        self.score[r[first], rank[first]], self.neighbour[r[first], rank[first]] = score[first], neighbour[first]

    def batch(self):
        import pyarrow as pa

        keep = (self.score >= self.least).ravel()
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, self.k)[keep]), pa.array(self.neighbour.ravel()[keep]), pa.array(self.score.ravel()[keep])], names=["id", "neighbour", "score"])


def _best_of_blocks(spread: DataFrame, k: int, least: float) -> DataFrame:
    """id, neighbour, score: of blocks (key, rows) against blocks (rows2) of _packed each row's k best, merged over all blocks it met. A block's lists are kept while rows of its key follow one another."""

    def run(batches):
        key, best = None, None
        for batch in batches:
            for at, left, right in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if best is None or at != key:
                    if best is not None:
                        yield best.batch()
                    key, best = at, _Best(*_matrix(left), k, least)
                best.meet(*_matrix(right)[:2])
        if best is not None:
            yield best.batch()

    partial = spread.select("key", "rows", "rows2").mapInArrow(run, "id long, neighbour long, score double")
    best = Window.partitionBy("id").orderBy(F.desc("score"), "neighbour")
    return partial.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= k).drop("_n")


def nearest_neighbours(vectors: DataFrame, k: int = 3, least: float = 0.35, rows_per_block: int = 4096) -> DataFrame:
    """id, neighbour, score: at most k neighbours of each vector by cosine, exact.

    Vectors are packed into blocks, a written table; every part of it meets every other in a task of its own, which reads both and compares block with block as matrices, so vectors are shuffled once. A window merges the blocks' lists of k for each row. Products grow with the square of the number of vectors; memory is that of two blocks and a part.
    """
    n = max(1, -(-vectors.count() // rows_per_block))
    block = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    packed = checkpointed(_packed(vectors.select("id", "vector", block.alias("key")).repartition(n, "key").groupBy("key").agg(F.collect_list(F.struct("id", "vector")).alias("rows")), k, least))
    return _best_of_blocks(packed.crossJoin(packed.select(F.col("rows").alias("rows2"))), k, least)


#: Lists of the approximate search: the root of the number of vectors, this many at most, and fewer where vectors must look into more than MOST_PROBES; vectors that are asked first to see how many lists it takes. All bound what goes to each task.
MOST_LISTS, MOST_PROBES, SAMPLE = 16_384, 16, 256


def _true_neighbours(vectors: DataFrame, ids: np.ndarray, x: np.ndarray, k: int, least: float) -> list:
    """(asker, vector): the k best of all vectors for each of a sample; one pass over all vectors."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                b, y = batch.column(0).to_numpy(), _normed(batch.column(1))
                s = np.round(x @ y.T, 9)
                s[ids[:, None] == b[None, :]] = -2
                order = np.argsort(-s, axis=1, kind="stable")[:, :k]
                score = np.take_along_axis(s, order, axis=1)
                asker = np.repeat(np.arange(len(ids)), order.shape[1])
                keep = (score >= least).ravel()
                near = order.ravel()[keep]
                yield pa.RecordBatch.from_arrays([pa.array(asker[keep]), pa.array(b[near]), pa.array(score.ravel()[keep]), pa.array(list(y[near]), pa.list_(pa.float64()))], names=["asker", "id", "score", "vector"])

    best = Window.partitionBy("asker").orderBy(F.desc("score"), "id")
    found = vectors.select("id", "vector").mapInArrow(run, "asker long, id long, score double, vector array<double>").withColumn("_n", F.row_number().over(best))
    return found.filter(F.col("_n") <= k).select("asker", "vector").collect()  # at most k for each of the sample


def _probes_needed(x: np.ndarray, pairs: list, middle: np.ndarray, recall: float) -> int:
    """How many of the lists around middle the sample x must look into to find the share recall of its true neighbours."""
    if not pairs:
        return 1
    home = np.argmax(_normed([r.vector for r in pairs]) @ middle.T, axis=1)
    rank = np.argsort(np.argsort(-(x @ middle.T), axis=1, kind="stable"), axis=1)
    ranks = np.sort(rank[[r.asker for r in pairs], home])
    return int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)]) + 1


def approximate_neighbours(vectors: DataFrame, k: int = 3, least: float = 0.35, recall: float = 0.95, rows_per_block: int = 4096, lists: int | None = None) -> DataFrame:
    """id, neighbour, score: at most k neighbours of each vector by cosine, scored exactly, found in the lists nearest to it.

    As many vectors as the root of their number are centres, drawn by their ids' hashes; every vector belongs to the list of its nearest centre and looks
    into those of its nearest centres, as many as SAMPLE of the vectors need for the share recall of their true neighbours. Where that is more than MOST_PROBES, half as
    many centres are taken, and so on: a vector is shuffled once for each list it looks into, which is few where vectors lie in clusters, and most of some large lists
    where they lie anywhere (and no index helps). Members and askers of a list meet in blocks of rows_per_block, so a crowded list is work for many tasks. A neighbour
    in another list is missed; tests hold recall against the exact search.
    """
    n = vectors.count()
    drawn = vectors.select("id", "vector", F.xxhash64("id", F.lit(7)).alias("h")).orderBy("h", "id")
    centres = drawn.limit(lists or int(min(MOST_LISTS, max(1, n**0.5)))).select("vector").collect()
    if not centres:
        return vectors.sparkSession.createDataFrame([], "id long, neighbour long, score double")
    middle = _normed([r.vector for r in centres])
    sample = vectors.select("id", "vector", F.xxhash64("id", F.lit(11)).alias("h")).orderBy("h", "id").limit(SAMPLE).select("id", "vector").collect()
    x = _normed([r.vector for r in sample])
    pairs = _true_neighbours(vectors, np.array([r.id for r in sample]), x, k, least)
    probes = _probes_needed(x, pairs, middle, recall)
    while lists is None and probes > MOST_PROBES:
        middle = middle[: (len(middle) + 1) // 2]
        probes = _probes_needed(x, pairs, middle, recall)

    def assign(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                near = np.argsort(-(_normed(batch.column(1)) @ middle.T), axis=1, kind="stable")[:, :probes]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(near.astype(np.int32)), pa.list_(pa.int32()))], names=["id", "vector", "lists"])

    kind = vectors.select("id", "vector", F.array(F.lit(0)).alias("lists")).schema
    placed = checkpointed(vectors.select("id", "vector").mapInArrow(assign, kind))
    home = placed.select(F.get("lists", F.lit(0)).alias("list"), "id", "vector")
    asked = placed.select(F.explode("lists").alias("list"), "id", "vector")

    def blocks(rows: DataFrame) -> DataFrame:
        """Blocks of about rows_per_block rows of each list."""
        parts = rows.groupBy("list").agg(F.ceil(F.count("*") / rows_per_block).cast("int").alias("parts"))  # at most MOST_LISTS rows
        dealt = rows.join(F.broadcast(parts), "list").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
        return _packed(dealt.groupBy("list", "part").agg(F.collect_list(F.struct("id", "vector")).alias("rows")))

    asking = blocks(asked).withColumn("key", F.struct("list", "part"))
    return _best_of_blocks(asking.join(blocks(home).select("list", F.col("rows").alias("rows2")), "list"), k, least)


def vector_top_k(vectors: DataFrame, query: list[float], k: int = 10) -> DataFrame:
    """id, score: the k vectors of largest cosine with a query, ties by id."""
    q = np.array(query) / max(1e-12, float(np.linalg.norm(query)))
    dot = F.aggregate(F.zip_with("vector", F.array(*(F.lit(float(x)) for x in q)), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(F.transform("vector", lambda a: a.cast("double") * a.cast("double")), F.lit(0.0), lambda s, x: s + x))
    return vectors.select("id", F.round(dot / F.greatest(norm, F.lit(1e-12)), 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)
