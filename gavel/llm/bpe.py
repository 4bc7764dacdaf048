"""Byte-level BPE encoding and decoding (operator 1).

Pre-tokenisation has no regular expression. Each code point gets a class from a
lookup array (letter, number, blank, other space, apostrophe that opens a
contraction, rest; spaces are split by whether the run of spaces goes on). A
small machine reads the classes. Each class is a function from state to state;
composition of such functions is associative, so a blocked prefix scan over
whole arrays yields the state before every code point, and a table lookup on
(state, class) says where slices begin. The slices go through a cache of merged
pieces. The lengths of tokens in bytes are kept as offsets, so that any token
range can be decoded or traced to its place in the text.

Defined results: a null or empty text has no tokens and decodes to the empty
string; rows may repeat; a text of any length is encoded whole; other columns are
kept, and an output column replaces one of the same name.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import as_bytes, bounded_batches, groups, mix, powers

#: Entries of the cache of merged pieces in each Python worker; it is emptied when full.
CACHE_ENTRIES = 800_000
#: Longer pieces are merged anew each time.
CACHED_PIECE_BYTES = 64

_BYTE = mix(np.arange(1, 257, dtype=np.uint64))

# classes
LETTER, NUMBER, REST, QUOTE1, QUOTE2, BLANK, BLANK_LAST, SPACE, SPACE_LAST, BREAK = range(10)
# states: what the slice that holds the last code point is, or FRESH if it is over
FRESH, IN_LETTERS, IN_NUMBERS, IN_REST, AFTER_BLANK, IN_SPACES, NEED1, NEED2 = range(8)


def _step(state: int, kind: int) -> tuple[int, bool]:
    """The next state, and whether a slice begins at this code point."""
    if kind == BREAK:
        return FRESH, False
    if state == NEED2:
        return NEED1, False
    if state == NEED1:
        return FRESH, False
    if kind in (BLANK, SPACE):
        return IN_SPACES, state != IN_SPACES
    if kind == BLANK_LAST:
        return AFTER_BLANK, True
    if kind == SPACE_LAST:
        return FRESH, True
    if kind == LETTER:
        return IN_LETTERS, state not in (IN_LETTERS, AFTER_BLANK)
    if kind == NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, AFTER_BLANK)
    if kind != REST and state not in (IN_REST, AFTER_BLANK):
        return (NEED1 if kind == QUOTE1 else NEED2), True
    return IN_REST, state not in (IN_REST, AFTER_BLANK)


@lru_cache(1)
def machine():
    """Functions that classes and their compositions make: (id of each class, composition table, value table, slice-begins table)."""
    kinds = [tuple(_step(s, k)[0] for s in range(8)) for k in range(10)]
    ids = {f: i for i, f in enumerate(dict.fromkeys(kinds))}
    todo = list(ids)
    for f in todo:  # grows until closed under composition
        for g in kinds:
            h = tuple(g[x] for x in f)
            if h not in ids:
                ids[h] = len(ids)
                todo.append(h)
    values = np.array(todo, dtype=np.uint8)
    compose = np.array([[ids[tuple(g[x] for x in f)] for g in todo] for f in todo], dtype=np.uint16)
    begins = np.array([[_step(s, k)[1] for k in range(10)] for s in range(8)])
    return np.array([ids[k] for k in kinds], dtype=np.uint16), compose, values, begins


@lru_cache(1)
def classes() -> np.ndarray:
    import regex

    table = np.full(0x110000, REST, dtype=np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        for m in regex.finditer(pattern, every):
            table[ord(m[0][0]) : ord(m[0][-1]) + 1] = kind
    table[0xD800:0xE000] = REST
    table[ord(" ")] = BLANK
    return table


def kinds_of(points: np.ndarray, table: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """The class of each code point; breaks: the places of the separators between texts."""
    kinds = table[points]
    kinds[breaks] = BREAK
    gap = (kinds == BLANK) | (kinds == SPACE)
    last = gap.copy()
    last[:-1] &= ~gap[1:] & (kinds[1:] != BREAK)
    last[-1] = False
    kinds[last] += 1
    quote = np.flatnonzero(points == 39)
    if len(quote):
        padded = np.concatenate([points, [0, 0]]).astype(np.uint32)
        one, two = padded[quote + 1], padded[quote + 2]
        kinds[quote[np.isin(one, list(map(ord, "stmd")))]] = QUOTE1
        for a, b in ("re", "ve", "ll"):
            kinds[quote[(one == ord(a)) & (two == ord(b))]] = QUOTE2
    return kinds


def scan(kinds: np.ndarray, width: int = 64) -> np.ndarray:
    """The state before each code point: a prefix scan of composed functions, along rows of width, over the rows' totals, then down again."""
    of_kind, compose, values, _ = machine()
    n = len(kinds)
    rows = -(-n // width)
    f = np.full(rows * width, of_kind[BREAK], dtype=np.uint16)
    f[:n] = of_kind[kinds]
    f = f.reshape(rows, width)
    upto = f.copy()
    for j in range(1, width):
        upto[:, j] = compose[upto[:, j - 1], f[:, j]]
    totals = upto[:, -1].copy()
    shift = 1
    while shift < rows:
        totals[shift:] = compose[totals[:-shift], totals[shift:]]
        shift *= 2
    enter = np.zeros(rows, dtype=np.uint8)  # FRESH at the start
    enter[1:] = values[totals[:-1], FRESH]
    before = np.empty((rows, width), dtype=np.uint8)
    before[:, 0] = enter
    before[:, 1:] = values[upto[:, :-1], enter[:, None]]
    return before.reshape(-1)[:n]


def slices(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The texts joined by line feeds; byte offsets where slices start and end; the index of each text's first slice, one more at the end."""
    joined = b"\n".join(texts)
    points = np.frombuffer(joined.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = 1 + (points > 0x7F) + (points > 0x7FF).astype(np.int8) + (points > 0xFFFF)
    at = np.zeros(len(points) + 1, dtype=np.int64)
    np.cumsum(sizes, out=at[1:])
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    if not len(points):
        return joined, at[:0], at[:0], np.zeros(len(texts) + 1, dtype=np.int64)
    breaks = np.searchsorted(at, bounds[1:-1] - 1)
    kinds = kinds_of(points, classes(), breaks)
    begins = machine()[3][scan(kinds), kinds]
    starts = at[:-1][begins]
    ends = np.append(starts[1:], len(joined))
    first = np.searchsorted(starts, bounds)
    closing = first[1:][first[1:] > first[:-1]] - 1  # the last slice of each text ends before the separator
    ends[closing] = (bounds[1:] - 1)[first[1:] > first[:-1]]
    return joined, starts, ends, first


def slice_hashes(joined: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of slices that follow one another (but for separators)."""
    buf = np.frombuffer(joined, dtype=np.uint8)
    first = starts[0]
    widths = np.diff(starts, append=len(buf))
    pos = np.arange(first, len(buf)) - np.repeat(starts, widths)
    terms = _BYTE[buf[first:]] * powers(int(widths.max()))[pos]
    terms[(ends - first)[ends < starts + widths]] = 0  # separators
    return mix(np.add.reduceat(terms, starts - first) + (ends - starts).astype(np.uint64))


class Codec(dict):
    """Ranks of byte strings, and the cache: piece -> its ids."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pieces = [b""] * (max(self.ranks.values()) + 1)
        for piece, rank in self.ranks.items():
            self.pieces[rank] = piece

        pairs = {}
        for piece, rank in self.ranks.items():
            for k in range(1, len(piece)):
                left, right = self.ranks.get(piece[:k]), self.ranks.get(piece[k:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pair_keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], dtype=np.int64)
        self.single = np.array([self.ranks[bytes([x])] for x in range(256)], dtype=np.int64)

    def merge_many(self, pieces: list[bytes]) -> list[np.ndarray]:
        """merge() for many short pieces at once: in each step every piece that still can merges its pair of lowest rank, the leftmost of them."""
        none = np.int64(1 << 40)
        out: list = [None] * len(pieces)
        which = np.arange(len(pieces))
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = self.single[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        while len(which):
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            keys = np.empty(len(ids), dtype=np.int64)
            keys[:-1] = ids[:-1] << 32 | ids[1:]
            keys[starts + sizes - 1] = -1
            at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
            rank = np.where(self.pair_keys[at] == keys, self.pair_ranks[at], none)
            low = np.minimum.reduceat(rank, starts)
            over = low == none
            if over.any():
                for w, a, n in zip(which[over].tolist(), starts[over].tolist(), sizes[over].tolist(), strict=True):
                    out[w] = ids[a : a + n]
                stay = np.repeat(~over, sizes)
                ids, rank, which, sizes, low = ids[stay], rank[stay], which[~over], sizes[~over], low[~over]
                if not len(which):
                    break
            owner = np.repeat(np.arange(len(which)), sizes)
            hit = np.flatnonzero(rank == low[owner])
            hit = hit[np.concatenate([[True], owner[hit[1:]] != owner[hit[:-1]]])]
            ids[hit] = rank[hit]
            stay = np.ones(len(ids), dtype=bool)
            stay[hit + 1] = False
            ids, sizes = ids[stay], sizes - 1
        return out

    def learn(self, pieces: list[bytes]) -> None:
        """Put the ids of pieces that the cache lacks into it."""
        lacking = [p for p in pieces if p not in self]
        if len(self) + len(lacking) > CACHE_ENTRIES:
            self.clear()
            lacking = pieces
        short = [p for p in lacking if len(p) <= CACHED_PIECE_BYTES]
        if short:
            for p, ids in zip(short, self.merge_many(short), strict=True):
                self[p] = ids.astype("<u4")

    def __missing__(self, piece: bytes) -> np.ndarray:
        return np.array(self.merge(piece), dtype="<u4")

    def merge(self, piece: bytes) -> list[int]:
        """Merge the pair of lowest rank, leftmost first, until none is left; a heap keeps long pieces near-linear."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        n, ranks = len(piece), self.ranks
        end = list(range(1, n + 1))  # of the part that starts here
        before = list(range(-1, n - 1))
        live = [True] * n
        heap = []

        def offer(i: int) -> None:
            if i >= 0 and (j := end[i]) < n and (r := ranks.get(piece[i : end[j]])) is not None:
                heapq.heappush(heap, (r, i, end[j]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, e = heapq.heappop(heap)
            if not live[i] or (j := end[i]) >= n or end[j] != e:
                continue
            live[j], end[i] = False, e
            if e < n:
                before[e] = i
            offer(i)
            offer(before[i])
        return [ranks[piece[i : end[i]]] for i in range(n) if live[i]]

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """For each text its ids. Equal slices of a group of texts are looked up once."""
        joined, starts, ends, first = slices(texts)
        if not len(starts):
            return [np.zeros(0, dtype="<u4") for _ in texts]
        _, example, inverse = np.unique(slice_hashes(joined, starts, ends), return_index=True, return_inverse=True)
        pieces = [joined[a:b] for a, b in zip(starts[example].tolist(), ends[example].tolist(), strict=True)]
        self.learn(pieces)
        found = list(map(self.__getitem__, pieces))
        flat = np.concatenate(found)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        begin = np.cumsum(sizes) - sizes
        n = sizes[inverse]
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.arange(upto[-1]) + np.repeat(begin[inverse] - upto[:-1], n)]
        return np.split(ids, upto[first[1:-1]])

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids.tolist()))


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def _with(df: DataFrame, fields: list[tuple[str, T.DataType]]) -> tuple[T.StructType, list[str]]:
    names = {n for n, _ in fields}
    kept = [f for f in df.schema.fields if f.name not in names]
    return T.StructType([*kept, *(T.StructField(n, t, True) for n, t in fields)]), [f.name for f in kept]


def encode(df: DataFrame, ranks: str, text: str = "text", ids: str = "ids", offsets: str | None = "offsets") -> DataFrame:
    """df with the ids of its texts (array<int>) and the byte offset at which each token starts (array<int>).

    ranks: path of a rank file that every executor has, such as a library's data file.
    """
    bounded_batches(df.sparkSession)
    fields = [(ids, T.ArrayType(T.IntegerType(), False))] + [(offsets, T.ArrayType(T.IntegerType(), False))] * bool(offsets)
    schema, kept = _with(df, fields)

    def run(batches):
        import pyarrow as pa

        c = codec(ranks)
        sizes = np.array([len(p) for p in c.pieces], dtype=np.int64)
        for batch in batches:
            texts = as_bytes(batch.column(batch.schema.get_field_index(text)))
            for a, b in groups(texts):
                lists = c.encode(texts[a:b])
                flat = np.concatenate(lists).astype(np.int32)
                bounds = np.cumsum([0, *map(len, lists)]).astype(np.int32)
                part = batch.slice(a, b - a)
                columns = [part.column(part.schema.get_field_index(n)) for n in kept]
                columns.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat)))
                if offsets:
                    upto = np.concatenate([[0], np.cumsum(sizes[flat])])
                    at = upto[:-1] - np.repeat(upto[bounds[:-1]], np.diff(bounds))
                    columns.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(at.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, ranks: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """df with the text that its ids stand for; null ids are an empty text."""
    bounded_batches(df.sparkSession)
    schema, kept = _with(df, [(text, T.StringType())])

    def run(batches):
        import pyarrow as pa

        c = codec(ranks)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            texts = [c.decode(np.array(x or [], dtype=np.int64)).decode("utf-8", "replace") for x in column.to_pylist()]
            columns = [batch.column(batch.schema.get_field_index(n)) for n in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], names=[f.name for f in schema.fields])

    return df.mapInArrow(run, schema)


def digest(df: DataFrame, ranks: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_tokens, SHA-256 of the packed ids, SHA-256 of what the ids decode to."""
    bounded_batches(df.sparkSession)
    source = df.select(key, text)
    schema = T.StructType([source.schema[key], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches):
        import pyarrow as pa

        c = codec(ranks)
        for batch in batches:
            texts = as_bytes(batch.column(1))
            n, ids, back = [], [], []
            for a, b in groups(texts):
                for found in c.encode(texts[a:b]):
                    n.append(len(found))
                    ids.append(hashlib.sha256(found.tobytes()).hexdigest())
                    back.append(hashlib.sha256(c.decode(found)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], names=schema.names)

    return source.mapInArrow(run, schema)


def token_lengths(df: DataFrame, ranks: str, text: str = "text") -> DataFrame:
    """One column n_tokens: the encoded length of each text."""
    bounded_batches(df.sparkSession)

    def run(batches):
        import pyarrow as pa

        c = codec(ranks)
        for batch in batches:
            texts = as_bytes(batch.column(0))
            n = [len(x) for a, b in groups(texts) for x in c.encode(texts[a:b])]
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], names=["n_tokens"])

    return df.select(text).mapInArrow(run, "n_tokens long")
