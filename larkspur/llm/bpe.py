"""Byte-level BPE encoding and decoding with public rank files.

Texts are cut into pieces without regular expressions: each code point's class (with what follows it) selects a
transition function of a small automaton; the functions form a finite monoid, so all prefixes compose in one associative
scan of table look-ups, and the state before each code point tells whether a piece starts there. Pieces are merged
pairwise by rank, each distinct piece once while it stays in the cache. Every id keeps its byte offset.
"""

from __future__ import annotations

import base64
import functools
import heapq
import itertools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import Chunk, as_bytes, spans, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
CACHE_PIECES = 150_000
#: Longer pieces are merged singly, with a heap.
SIDE_BY_SIDE = 64
#: Code point classes, and the symbols the automaton reads.
LETTER, NUMBER, OTHER, SPACE, DOCUMENT = range(5)
S_LETTER, S_NUMBER, S_OTHER, S_SHORT, S_LONG, S_INNER, S_LAST, S_BLANK, S_DOCUMENT = range(9)
#: States: inside letters, numbers, others, white space; after a blank that joins what follows; one or two letters of a contraction to come; piece ended.
IN_LETTER, IN_NUMBER, IN_OTHER, IN_SPACE, BLANK, ONE, TWO, ENDED = range(8)
#: Code points that count as white space, and what may follow an apostrophe in a contraction.
WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SHORT, LONG = "stmd", ("re", "ve", "ll")
#: Letters and numbers that Unicode 16.0 has beyond 15.1 (first and last of each range), and how many letters
#: and numbers 16.0 has.
LETTERS_16 = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NUMBERS_16 = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
N_LETTERS, N_NUMBERS = 141_028, 1_911


@functools.cache
def classes() -> np.ndarray:
    """Each code point's class in Unicode 16.0, whether Python knows 15.1 or 16.0; with any other it raises."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    for kind, ranges in ((LETTER, LETTERS_16), (NUMBER, NUMBERS_16)):
        for first, last in ranges:
            out[first : last + 1] = kind
    if ((out == LETTER).sum(), (out == NUMBER).sum()) != (N_LETTERS, N_NUMBERS):
        raise RuntimeError(f"letters of Unicode {unicodedata.unidata_version} are not those of 16.0")
    out[WHITE] = SPACE
    return np.append(out, np.uint8(DOCUMENT))


def step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a piece starts at this code point."""
    if symbol == S_LETTER:
        return {IN_LETTER: (IN_LETTER, False), BLANK: (IN_LETTER, False), ONE: (ENDED, False), TWO: (ONE, False)}.get(state, (IN_LETTER, True))
    if symbol == S_NUMBER:
        return IN_NUMBER, state not in (IN_NUMBER, BLANK)
    if symbol in (S_OTHER, S_SHORT, S_LONG):
        if state in (IN_OTHER, BLANK):
            return IN_OTHER, False
        return {S_OTHER: IN_OTHER, S_SHORT: ONE, S_LONG: TWO}[symbol], True
    if symbol == S_INNER:
        return IN_SPACE, state != IN_SPACE
    return {S_LAST: IN_SPACE, S_BLANK: BLANK, S_DOCUMENT: ENDED}[symbol], True


@functools.cache
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The functions generated by the symbols: each symbol's number, products (first, then second), state reached from a
    fresh start, and which (state, symbol) starts a piece."""
    symbols = [tuple(step(s, x)[0] for s in range(8)) for x in range(9)]
    known = {f: i for i, f in enumerate(dict.fromkeys([tuple(range(8)), *symbols]))}
    todo = list(known)
    while todo:
        f = todo.pop()
        for g in symbols:
            h = tuple(g[s] for s in f)
            if h not in known:
                known[h] = len(known)
                todo.append(h)
    product = np.array([[known[tuple(g[s] for s in f)] for g in known] for f in known], np.uint8)
    starts = np.array([[step(s, x)[1] for x in range(9)] for s in range(8)])
    return np.array([known[f] for f in symbols], np.uint8), product, np.array([f[ENDED] for f in known], np.uint8), starts


def scan(x: np.ndarray, product: np.ndarray, block: int = 64) -> np.ndarray:
    """All prefix products of monoid elements, block-wise: within blocks side by side, then over the blocks' totals."""
    n = len(x)
    if n == 0:
        return x
    rows = -(-n // block)
    grid = np.zeros(rows * block, np.uint8)  # element 0 is the identity
    grid[:n] = x
    grid = np.ascontiguousarray(grid.reshape(rows, block).T)
    for k in range(1, block):
        grid[k] = product[grid[k - 1], grid[k]]
    if rows > 1:
        before = np.append(np.uint8(0), scan(np.ascontiguousarray(grid[-1]), product, block)[:-1])
        grid = product[before[None, :], grid]
    return np.ascontiguousarray(grid.T).ravel()[:n]


def piece_starts(points: np.ndarray) -> np.ndarray:
    """Flags for code points at which a piece starts; 0x110000 stands before each document (and is flagged)."""
    kind = classes()[points]
    after = np.append(kind[1:], np.uint8(DOCUMENT))
    symbol = np.array([S_LETTER, S_NUMBER, S_OTHER, S_INNER, S_DOCUMENT], np.uint8)[kind]
    last = (kind == SPACE) & (after != SPACE) & (after != DOCUMENT)
    symbol[last] = S_LAST
    symbol[last & (points == 32)] = S_BLANK
    at = np.flatnonzero(points == 39)
    padded = np.append(points, [0x110000] * 2)
    one, two = padded[at + 1], padded[at + 2]
    symbol[at[np.isin(one, [ord(c) for c in SHORT])]] = S_SHORT
    for a, b in LONG:
        symbol[at[(one == ord(a)) & (two == ord(b))]] = S_LONG
    of, product, reached, starts = monoid()
    state = reached[scan(of[symbol], product)]
    return starts[np.append(np.uint8(ENDED), state[:-1]), symbol]


class Pairs:
    """The rank of each two neighbouring tokens whose bytes together are a token, as one sorted array of pairs."""

    NONE = np.int32(1 << 30)

    def __init__(self, ranks: dict[bytes, int]):
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        found = {ranks[t[:i]] << 32 | ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.keys = np.array(sorted(found), np.int64)
        self.rank = np.array([found[k] for k in self.keys.tolist()], np.int32)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(a.shape, self.NONE)
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.rank[at], self.NONE)


def merge_many(pieces: list[bytes], pairs: Pairs) -> list[list[int]]:
    """The ids of pieces of like lengths, all merged side by side: in each step every piece joins its pair of least rank,
    the leftmost first, until it has none."""
    n = np.fromiter(map(len, pieces), np.int64, len(pieces))
    wide = int(n.max())
    inside = np.arange(wide) < n[:, None]
    tokens = np.full((len(pieces), wide + 1), -1, np.int32)
    tokens[:, :wide][inside] = pairs.single[np.frombuffer(b"".join(pieces), np.uint8)]
    rank = pairs(tokens[:, :-1], tokens[:, 1:])
    out: list[list[int]] = [[]] * len(pieces)
    live = np.arange(len(pieces))
    columns = np.arange(wide)
    while len(live):
        at = rank.argmin(1)
        rows = np.arange(len(live))
        least = rank[rows, at]
        ended = least == Pairs.NONE
        for i, t, k in zip(live[ended].tolist(), tokens[ended].tolist(), (tokens[ended] >= 0).sum(1).tolist(), strict=True):
            out[i] = t[:k]
        if ended.any():
            live, tokens, rank, at, least = (x[~ended] for x in (live, tokens, rank, at, least))
            rows = rows[: len(live)]
        tokens[rows, at] = least
        after = columns + (columns > at[:, None])
        tokens[:, :wide] = np.take_along_axis(tokens, after, 1)
        tokens[:, wide] = -1
        rank = np.take_along_axis(rank, np.minimum(after, wide - 1), 1)
        rank[rows, at] = pairs(tokens[rows, at], tokens[rows, at + 1])
        before = np.maximum(at - 1, 0)
        rank[rows, before] = np.where(at > 0, pairs(tokens[rows, before], tokens[rows, before + 1]), rank[rows, before])
        keep = max(1, int((tokens >= 0).sum(1).max())) if len(live) else 1
        tokens, rank, columns, wide = tokens[:, : keep + 1], rank[:, :keep], columns[:keep], keep
    return out


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    n = len(piece)
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)

    def offer(i: int) -> None:
        if (j := after[i]) < n and (r := ranks.get(piece[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[j]))

    while heap:
        _, i, e = heapq.heappop(heap)
        if not alive[i] or after[i] >= n or end[after[i]] != e:
            continue
        j = after[i]
        alive[j], end[i], after[i] = False, e, after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return tuple(ranks[piece[i : end[i]]] for i in range(n) if alive[i])


class Codec:
    """A rank table with a bounded cache of merged pieces: what is used again outlives the cache's turn."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.pairs = ranks, Pairs(ranks)
        self.cache: dict[bytes, tuple[int, ...] | list[int]] = {}
        self.older = self.cache
        size = max(ranks.values(), default=-1) + 1
        tokens = [b""] * size
        for t, r in ranks.items():
            tokens[r] = t
        self.lengths = np.fromiter(map(len, tokens), np.int64, size)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def ids_of(self, pieces: list[bytes]) -> list:
        """The ids of each piece; those not in the cache are merged together, by length."""
        if len(self.cache) + len(pieces) > CACHE_PIECES:
            self.cache, self.older = {}, self.cache
        cache, older, ranks = self.cache, self.older, self.ranks
        new: dict[int, list[bytes]] = {}
        for p in pieces:
            if p not in cache:
                if (got := older.get(p)) is not None:
                    cache[p] = got
                elif (whole := ranks.get(p)) is not None:
                    cache[p] = (whole,)
                elif len(p) <= SIDE_BY_SIDE:
                    new.setdefault(len(p).bit_length(), []).append(p)
        for like in new.values():
            for i in range(0, len(like), 4096):
                cache |= zip(like[i : i + 4096], merge_many(like[i : i + 4096], self.pairs), strict=True)
        return [cache[p] if p in cache else _merge_long(p, ranks) for p in pieces]

    def encode_flat(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where each text's begin (one entry more than texts).

        Pieces are told apart by hash, each distinct one is merged once, and every piece's bytes are held against those
        of the one that stands for it.
        """
        points, begins = [], np.cumsum([0, *(len(t) for t in texts)])
        whole = b"".join(texts)
        for t in texts:
            points += [np.array([0x110000], np.uint32), np.frombuffer(t.decode("utf-8").encode("utf-32-le"), np.uint32)]
        cp = np.concatenate(points) if points else np.zeros(0, np.uint32)
        flags = piece_starts(cp)
        width = 1 + (cp > 0x7F) + (cp > 0x7FF) + (cp > 0xFFFF)
        is_doc = cp == 0x110000
        width[is_doc] = 0
        at = np.cumsum(width) - width
        starts = at[flags & ~is_doc]
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        ends = np.append(starts[1:], len(whole))
        chunk = Chunk([whole])
        _, first, which = np.unique(chunk.hash(starts, ends), return_index=True, return_inverse=True)
        stand, size = starts[first][which], ends - starts
        off = np.arange(len(whole)) - np.repeat(starts, size)
        if (ends[first][which] - stand != size).any() or (chunk.buf[np.repeat(stand, size) + off] != chunk.buf[: len(whole)]).any():
            first, which = np.arange(len(starts)), np.arange(len(starts))  # two pieces of one hash
        found = self.ids_of([whole[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])
        n = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(itertools.chain.from_iterable(found), np.int32, int(n.sum()))
        count = n[which]
        stop = np.cumsum(count)
        ids = flat[np.arange(int(stop[-1])) + np.repeat((np.cumsum(n) - n)[which] - (stop - count), count)]
        return ids, np.append(0, stop)[np.searchsorted(starts, begins)]

    def encode(self, texts: list[bytes]) -> list[list[int]]:
        """Ids of each text."""
        flat, edges = self.encode_flat(texts)
        return [flat[a:b].tolist() for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def decode(self, ids: np.ndarray) -> bytes:
        lengths = self.lengths[ids]
        stop = np.cumsum(lengths)
        at = np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(self.begins[ids] - (stop - lengths), lengths)
        return self.flat[at].tobytes()


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one token in base64 and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


_codecs: dict[int, Codec] = {}


def _codec(held) -> Codec:
    """One codec for each rank table in a worker, its cache kept from task to task."""
    if held.id not in _codecs:
        _codecs.clear()
        _codecs[held.id] = Codec(held.value)
    return _codecs[held.id]


class Ranks:
    """A broadcast rank table (as large as its file, a megabyte or two) with a name of its own."""

    def __init__(self, spark: SparkSession, path: str):
        self._held = spark.sparkContext.broadcast(load_ranks(path))
        self.id = self._held._jbroadcast.id() if self._held._jbroadcast else 0

    def __getstate__(self):
        return {"_held": self._held, "id": self.id}

    @property
    def value(self) -> dict[bytes, int]:
        return self._held.value


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs with ids (array of int) and offsets (the byte each id starts at) in place of the text.

    Null text: as empty, no ids. Empty table: empty result. Columns of docs named ids or offsets are replaced.
    """
    docs = docs.drop("ids", "offsets")
    keep = [f for f in docs.schema.fields if f.name != text]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "ids array<int>, offsets array<int>"])
    ranks = Ranks(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks)
        for b in batches:
            texts = as_bytes(b.column(b.num_columns - 1))
            for i, j in spans(texts):
                flat, edges = codec.encode_flat(texts[i:j])
                sizes, edges = np.diff(edges), edges.astype(np.int32)
                lengths = codec.lengths[flat]
                offsets = np.cumsum(lengths) - lengths
                offsets -= np.repeat(np.append(offsets, 0)[np.minimum(edges[:-1], len(offsets))], sizes)
                lists = [pa.ListArray.from_arrays(pa.array(edges), pa.array(x.astype(np.int32))) for x in (flat, offsets)]
                yield pa.RecordBatch.from_arrays([*(c[i:j] for c in b.columns[:-1]), *lists], [*b.schema.names[:-1], "ids", "offsets"])

    return docs.select(*(F.col(f"`{f.name}`") for f in keep), F.col(text)).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """encoded with decoded, the ids' bytes. Null ids: empty. Ids outside the vocabulary raise."""
    encoded = encoded.drop("decoded")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields), "decoded binary"])
    ranks = Ranks(encoded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks)
        for b in batches:
            column = b.column(b.schema.get_field_index(ids))
            decoded = [codec.decode(np.asarray(x.values if x.is_valid else [], np.int64)) for x in column]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(decoded, pa.binary())], [*b.schema.names, "decoded"])

    return encoded.mapInArrow(run, schema)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path(VOCABULARY)
    coded = decode(encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path), path)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
