"""Jaccard join of documents on word n-grams.

Blocks first: a document's shingles are dealt by hash to one part more than two similar sets can differ in, so similar
sets agree on a whole part (pigeonhole; exact, no sampling). Documents that agree on a part fall into one block. Lines
that many texts have join unlike ones into a large block; there only those sets go on, and are dealt again, that have
enough of their shingles in common with others of the block to link with any of them. Inside a block the links are found by T-occurrence search: inverted lists of the block's shingles, short lists merged by a heap
that skips, long lists probed by binary search (DivideSkip), and documents kept that reach the required overlap.
"""

from __future__ import annotations

import heapq
import math
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .textkit import Chunk, U, as_bytes, bucket_count, cut, discard, mix, pack, shingles, spans, table, unpack

WIDTH, PERCENT = 3, 90
NO_ID = -(1 << 63)
FLUSH = 1 << 19
#: Bytes of text, and shingles, that one NumPy call works on: their arrays stay in a processor's cache.
SPAN_BYTES, SPAN_SETS = 1 << 16, 1 << 15
#: The odd multiplier of a shingle's words.
STEP = U(0xD6E8FEB86659FD93)
#: Larger blocks are searched tile by tile: each two of their parts of about so many shingles, or sets, together.
TILE, TILE_SETS = 1 << 20, 1024
#: Blocks' members that are broadcast at most (some 40 bytes each); beyond it they are joined by a shuffle.
BROADCAST_ROWS = 500_000


def distinct(s: np.ndarray) -> np.ndarray:
    """Sorted, each value once."""
    s = np.sort(s)
    new = s[1:] != s[:-1]
    return s if new.all() else s[np.append(True, new)]


def sets_of(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words than width: the whole sequence as one; none: empty.

    Word hashes are sums of a polynomial, mixed once for a shingle; the words of a span of texts are hashed together, and
    the shingles that begin in one text and end in the next are left out."""
    out = []
    for i, j in spans(texts, SPAN_BYTES):
        words, bounds = Chunk(texts[i:j], lower=True).word_hashes()
        runs = words[: max(0, len(words) - width + 1)].copy()
        for k in range(1, width):
            runs *= STEP
            runs += words[k : k + len(runs)]
        runs = mix(runs)
        bounds = bounds.tolist()
        for s, e in zip(bounds[:-1], bounds[1:], strict=True):
            w = words[s:e]
            out.append(distinct(runs[s : e - width + 1]) if e - s >= width else mix(shingles(w, e - s) + U(e - s)) if e > s else w)
    return out


def size_classes(percent: int, most: int) -> list[int]:
    """Smallest set size of each class; sizes within a class differ by half at most."""
    lows = [1]
    while lows[-1] <= most:
        lows.append(max(lows[-1] + 1, lows[-1] * 3 // 2))
    return lows


def _class_signatures(sets: list[np.ndarray], n: np.ndarray, c: np.ndarray, percent: int, lows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values = np.concatenate(sets)
    differ = 2 * (lows[c + 1] - 1) * (100 - percent) // (100 + percent)
    m = np.where(differ > 0, differ + np.maximum(2, differ * 36 // 100), 1)
    first = np.cumsum(m) - m
    part = ((values & U(0xFFFFFFFF)) * np.repeat(m, n).astype(U) >> U(32)).astype(np.int64) + np.repeat(first, n)
    counts, sums = np.bincount(part, minlength=m.sum()), np.zeros(m.sum(), U)
    np.add.at(sums, part, values)
    # no similar set is larger than 100 / percent times this one
    own = np.minimum(differ, (100 - percent) * (n + 100 * n // percent) // (100 + percent))
    owner = np.repeat(np.arange(len(n)), m)
    most = np.sort(owner << 32 | counts)[first + m - 1 - own] & 0xFFFFFFFF
    use = np.flatnonzero(counts >= most[owner])
    owner = owner[use]
    return mix(sums[use] + mix((use - first[owner]).astype(U) + (c[owner].astype(U) << U(32)) + U(1 << 60))), owner


def signatures(sets: list[np.ndarray], percent: int, lows: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of which any two sets with that Jaccard similarity share one, and the position of each one's set.

    Such sets differ in at most (100 - percent) / (100 + percent) of their summed sizes, and so on as many parts at most.
    A set with t shingles or more in more parts than that agrees on one of these, so the largest such t counts: parts
    with few shingles tell little, those without nothing. Of two sets the one with the larger t decides. Shingles are
    hashes, so half of their bits deals them to parts as they are.
    """
    bounds, sigs, owners = np.array(lows), [], []
    for i, j in spans(sets, SPAN_SETS):
        n = np.fromiter(map(len, sets[i:j]), np.int64, j - i)
        k = np.searchsorted(bounds, n, "right") - 1
        next_too = np.flatnonzero(100 * n >= percent * bounds[k + 1])
        for at, c in ((np.arange(j - i), k), (next_too, k[next_too] + 1)):
            if len(at):
                sig, owner = _class_signatures([sets[i + x] for x in at.tolist()], n[at], c, percent, bounds)
                sigs.append(sig)
                owners.append(i + at[owner])
    return np.concatenate(sigs), np.concatenate(owners)


def part_signatures(s: np.ndarray, percent: int, lows: list[int]) -> np.ndarray:
    """The signatures of one set."""
    return signatures([s], percent, lows)[0]


def set_hashes(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of hash for each set, in two halves: sums of its shingles as they are, and mixed once more."""
    halves: tuple[list, list] = [], []
    for i, j in spans(sets, SPAN_SETS):
        ends = np.cumsum(np.fromiter(map(len, sets[i:j]), np.int64, j - i))
        values = np.concatenate(sets[i:j])
        for half, x in zip(halves, (values, mix(values)), strict=True):
            half.append(np.diff(np.append(U(0), np.cumsum(x, dtype=U))[ends], prepend=U(0)))
    return np.concatenate(halves[0]), np.concatenate(halves[1])


def _profile(width: int, percent: int, buckets: int):
    """Packed signatures for each bucket, and each document's id, set size, 128-bit set hash and the id that stands for
    its set among the documents flushed together, packed too."""

    def flush(ids: list, sets: list, at: int) -> Iterator[tuple[int, int, bytes]]:
        ids = np.array(ids, np.int64)
        n = np.fromiter(map(len, sets), np.int64, len(sets))
        s1, s2 = set_hashes(sets)
        own = np.flatnonzero((n > 0) & (ids != NO_ID))
        _, first, which = np.unique(np.rec.fromarrays([n[own], s1[own], s2[own]]), return_index=True, return_inverse=True)
        use, like = own[first], ids.copy()
        like[own] = ids[use][which]
        yield at % buckets, 1, pack(ids, n, s1, s2, like)
        if not len(use):
            return
        sig, own = signatures([sets[i] for i in use.tolist()], percent, size_classes(percent, 2 * int(n.max()) + 4))
        names, place = np.unique(ids[use], return_inverse=True)
        order = np.argsort(sig)
        sig, own = sig[order], place[own[order]]
        head = np.append(True, sig[1:] != sig[:-1])
        pivot = own[head][np.cumsum(head) - 1]
        if (other := pivot != own).any():
            pairs = np.unique(own[other] * len(names) + pivot[other])
            yield at % buckets, 2, pack(names[pairs // len(names)], names[pairs % len(names)])
        # buckets are ranges of signatures, so they lie in order
        sig, own = sig[head], own[head]
        to = ((sig >> U(32)) * U(buckets) >> U(32)).astype(np.int64)
        cuts = np.searchsorted(to, np.arange(buckets + 1))
        docs, where = np.unique(to * len(names) + own, return_inverse=True)
        of = np.searchsorted(docs, np.arange(buckets + 1) * len(names))
        for b in range(buckets):
            if cuts[b] < cuts[b + 1]:
                x = slice(cuts[b], cuts[b + 1])
                yield b, 0, pack(np.diff(sig[x], prepend=U(0)), names[docs[of[b] : of[b + 1]] - b * len(names)], (where[x] - of[b]).astype(np.uint32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sets, size, at = [], [], 0, 0
        names = ["bucket", "kind", "blob"]

        def out() -> Iterator[pa.RecordBatch]:
            for b, k, blob in flush(ids, sets, at):
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([k], pa.int32()), pa.array([blob], pa.binary())], names)

        for b in batches:
            texts = as_bytes(b.column(1))
            keys = [NO_ID if x is None else x for x in b.column(0).to_pylist()]
            for i, j in spans(texts):
                new = sets_of(texts[i:j], width)
                ids += keys[i:j]
                sets += new
                size += sum(map(len, new))
                at = at or (hash(keys[i]) & 0x7FFFFFFF)
                if size >= 4 * FLUSH or len(ids) >= FLUSH:
                    yield from out()
                    ids, sets, size, at = [], [], 0, at + 1
        if ids:
            yield from out()

    return run


PROFILE = "kind int, a long, b long, n long, s1 long, s2 long"


def _meet(t: pa.Table) -> pa.Table:
    """Star edges between documents that share a signature; profiles pass through."""
    cols: list[list[np.ndarray]] = [[] for _ in range(6)]

    def add(kind: int, a, b=None, n=None, s1=None, s2=None) -> None:
        zero = np.zeros(len(a), np.int64)
        for c, x in zip(cols, (zero + kind, a, b, n, s1, s2), strict=True):
            c.append(zero if x is None else x.view(np.int64))

    sigs, docs = [], []
    for kind, blob in zip(t["kind"].to_pylist(), t["blob"].to_pylist(), strict=True):
        if kind == 1:
            ids, n, s1, s2, like = unpack(blob)
            add(1, ids, like, n, s1, s2)
        elif kind == 2:
            add(0, *unpack(blob))
        else:
            step, own, where = unpack(blob)
            sigs.append(np.cumsum(step, dtype=U))
            docs.append(own[where])
    if sigs:
        sig, doc = np.concatenate(sigs), np.concatenate(docs)
        order = np.argsort(sig, kind="stable")
        sig, doc = sig[order], doc[order]
        head = np.append(True, sig[1:] != sig[:-1])
        pivot = doc[head][np.cumsum(head) - 1]
        if (other := pivot != doc).any():
            add(0, *np.unique(np.stack([doc[other], pivot[other]]), axis=1))
    whole = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in cols]
    return pa.table({"kind": whole[0].astype(np.int32), "a": whole[1], "b": whole[2], "n": whole[3], "s1": whole[4], "s2": whole[5]})


class Index:
    """Inverted lists of a block: for each shingle the positions of the documents that have it, in order. Shingles of one
    document alone are left out: they are in no overlap."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = [len(s) for s in sets]
        self.least = min(self.sizes)
        keys = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        runs = array("i", owner[order].astype(np.int32).tobytes())
        ends = np.append(heads[1:], len(keys))
        many = ends - heads > 1
        self.lists = {k: runs[s:e] for k, s, e in zip(keys[heads[many]].tolist(), heads[many].tolist(), ends[many].tolist(), strict=True)}


def merge_skip(lists: list[array], need: int) -> Iterator[tuple[int, int]]:
    """(value, how many of the sorted lists have it), for values in at least need of them."""
    heap = [(x[0], i, 0) for i, x in enumerate(lists)]
    heapq.heapify(heap)
    while len(heap) >= need:
        top, popped = heap[0][0], []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap))
        if len(popped) >= need:
            yield top, len(popped)
            floor = top + 1
        else:
            while heap and len(popped) < need - 1:
                popped.append(heapq.heappop(heap))
            if not heap:
                return
            floor = heap[0][0]
        for _, i, p in popped:
            p = bisect_left(lists[i], floor, p)
            if p < len(lists[i]):
                heapq.heappush(heap, (lists[i][p], i, p))


def divide_skip(index: Index, query: np.ndarray, percent: int, skip) -> Iterator[int]:
    """Positions in the index of the sets similar to the query, but for those that skip() names.

    The overlap to reach follows from the least size that an indexed set similar to the query can have.
    """
    n = len(query)
    least = max(index.least, -(-percent * n // 100))
    need = -(-percent * (n + least) // (100 + percent))
    lists = sorted((x for k in query.tolist() if (x := index.lists.get(k)) is not None), key=len)
    if len(lists) < need:
        return
    longest = len(lists[-1])
    n_long = min(need - 1, int(need / (0.0085 * math.log2(longest) + 1))) if longest > 1 else need - 1
    short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
    for j, have in merge_skip(short, need - n_long):
        size = index.sizes[j]
        if 100 * size < percent * n or 100 * n < percent * size or skip(j):
            continue
        want = -(-percent * (n + size) // (100 + percent))
        for k, x in enumerate(long):
            if have >= want or have + len(long) - k < want:
                break
            p = bisect_left(x, j)
            have += p < len(x) and x[p] == j
        if have >= want:
            yield j


def block_links(ids: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join what is linked: a forest with the components of all links in a block.

    First each document looks for one link; who finds none has none. A link that still joins two components has an end
    outside the largest one, so only the linked documents out there look for all their links.
    """
    index, parent, out = Index(sets), list(range(len(ids))), []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def join(a: int, b: int) -> None:
        if find(a) != find(b):
            parent[find(a)] = find(b)
            out.append((ids[a], ids[b]))

    found = []
    for q in range(len(ids)):
        p = next(divide_skip(index, sets[q], percent, lambda x, q=q: x == q), None)
        if p is not None:
            join(p, q)
            found.append(q)
    sizes = Counter(map(find, found))
    if len(sizes) > 1:
        largest = sizes.most_common(1)[0][0]
        for q in [q for q in found if find(q) != find(largest)]:
            for p in divide_skip(index, sets[q], percent, lambda x, q=q: find(x) == find(q)):
                join(p, q)
    return out


def _search(percent: int):
    def run(t: pa.Table) -> pa.Table:
        ids, blobs = t["doc_id"].to_pylist(), t["blob"]
        tiles: dict[tuple, list[int]] = {}
        for r, key in enumerate(zip(t["block"].to_pylist(), t["band"].to_pylist(), t["i"].to_pylist(), t["j"].to_pylist(), strict=True)):
            tiles.setdefault(key, []).append(r)
        links = []
        for rows in tiles.values():
            links += block_links([ids[r] for r in rows], [np.frombuffer(blobs[r].as_py(), U) for r in rows], percent)
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([x for _, x in links], pa.int64())})

    return run


def _set_blobs(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = sets_of(as_bytes(b.column(b.num_columns - 1)), width)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([x.tobytes() for x in sets], pa.binary())], [*b.schema.names[:-1], "blob"])

    return run


def _deal(width: int, buckets: int):
    """Packed shingles for each bucket: 32 bits of the hash of block and shingle, and whose they are."""

    def flush(ids: list, blocks: list, sets: list) -> Iterator[tuple[int, bytes]]:
        sizes = [len(s) for s in sets]
        keys = mix(np.concatenate(sets) + np.repeat(np.array(blocks, np.int64).view(U), sizes))
        own, to, low = np.repeat(np.array(ids, np.int64), sizes), (keys >> U(32)) % U(buckets), keys.astype(np.uint32)
        order = np.lexsort((low, to))
        cuts = np.searchsorted(to[order], np.arange(buckets + 1))
        for b in range(buckets):
            if cuts[b] < cuts[b + 1]:
                x = order[cuts[b] : cuts[b + 1]]
                docs, where = np.unique(own[x], return_inverse=True)
                yield b, pack(np.diff(low[x], prepend=np.uint32(0)), docs, where.astype(np.uint32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, blocks, sets, size = [], [], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            for b, blob in flush(ids, blocks, sets):
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([blob], pa.binary())], ["bucket", "blob"])

        for b in batches:
            texts, keys, of = as_bytes(b.column(2)), b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, j in spans(texts):
                new = sets_of(texts[i:j], width)
                ids += keys[i:j]
                blocks += of[i:j]
                sets += new
                size += sum(map(len, new))
                if size >= 4 * FLUSH:
                    yield from out()
                    ids, blocks, sets, size = [], [], [], 0
        if ids:
            yield from out()

    return run


def _shared(t: pa.Table) -> pa.Table:
    """How many shingles of this bucket each document has that occur again in it."""
    parts = [unpack(x) for x in t["blob"].to_pylist()]
    low = np.concatenate([np.cumsum(x[0], dtype=np.uint32) for x in parts])
    doc = np.concatenate([x[1][x[2]] for x in parts])
    order = np.argsort(low, kind="stable")
    same = np.diff(low[order]) == 0
    ids, n = np.unique(doc[order[np.append(False, same) | np.append(same, False)]], return_counts=True)
    return pa.table({"doc_id": ids, "shared": n.astype(np.int64)})


def _few(ids: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(ids) if rows <= BROADCAST_ROWS else ids


def linkable(docs: DataFrame, members: DataFrame, rows: int, size: int, width: int, percent: int) -> DataFrame:
    """doc_id of those members (doc_id, n, block) that may link with another of their block: percent of their shingles or
    more occur in it again. No link is lost: what two linked sets share occurs in both. Equal hashes of unlike shingles
    only let more through. rows and size: how many members there are, and shingles of theirs."""
    buckets = max(bucket_count(rows), math.ceil(size / (8 * FLUSH)))
    of = _few(members.select("doc_id", "block").distinct(), rows)
    dealt = docs.join(of, "doc_id").select("doc_id", "block", "text").mapInArrow(_deal(width, buckets), "bucket int, blob binary")
    shared = dealt.groupBy("bucket").applyInArrow(_shared, "doc_id long, shared long").groupBy("doc_id").agg(F.sum("shared").alias("shared"))
    return shared.join(members, "doc_id").where(100 * F.col("shared") >= percent * F.col("n")).select("doc_id").distinct()


def rounds(tiles: int, wide: int, whole: int) -> list[tuple[int, int]]:
    """Distances [low, high) of parts on their ring that are searched together, so that every two of so many parts meet
    once. A set goes to two tiles for each distance: a round copies half as many shingles as all sets have, or goes one
    distance far. wide: shingles of the sets in tiles, whole: of all."""
    step = max(1, whole // (4 * max(1, wide)))
    return [(d, min(d + step, tiles // 2 + 1)) for d in range(1, tiles // 2 + 1, step)]


def in_tiles(held: DataFrame, low: int, high: int) -> DataFrame:
    """Each set once for each tile (i, j) of its part and one that lies low to high - 1 parts away on the ring."""
    near = f"filter(sequence({low}, {high - 1}), d -> d <= tiles div 2)"
    others = F.expr(f"array_distinct(flatten(transform({near}, d -> array(pmod(chunk + d, tiles), pmod(chunk - d, tiles)))))")
    far = held.withColumn("other", F.explode(others))
    return far.select("doc_id", "block", "band", "blob", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))


def linked(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row for each row of docs, in its own terms.

    Two documents link when percent of their union is shared. component_id is the smallest id reachable by links, the
    own one included. Null or wordless texts have no shingles and link with nothing. Rows with one id are one document
    for linking, and each keeps its own n_shingles. A row without id has component null. Empty table: empty result.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = docs.count()

    def meet(docs: DataFrame, rows: int) -> DataFrame:
        buckets = bucket_count(rows)
        return cut(docs.mapInArrow(_profile(width, percent, buckets), "bucket int, kind int, blob binary").groupBy("bucket").applyInArrow(_meet, PROFILE))

    met = meet(docs, rows)
    profile = cut(met.where("kind = 1").select(F.col("a").alias("doc_id"), F.col("b").alias("like"), "n", "s1", "s2"))
    real = profile.where(f"n > 0 and doc_id <> {NO_ID}")
    # equal sets: within a flush each names its stand-in, so that a class has a row for each flush when the flushes meet
    stands = real.where("doc_id = like").select("doc_id", "n", "s1", "s2").distinct()
    classes = stands.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).where("rep < last")
    across = cut(stands.join(classes, ["n", "s1", "s2"]).where("doc_id <> rep").select("doc_id", "rep"))
    copies = across.union(real.where("doc_id <> like").select("doc_id", F.col("like").alias("rep")).distinct())
    near = met.where("kind = 0").select("a", "b").distinct()
    # what stands for equal sets; an id with several sets stands for itself, or the links of the others would be lost
    one = F.struct("n", "s1", "s2")
    several = real.groupBy("doc_id").agg(F.min(one).alias("x"), F.max(one).alias("y")).where("x <> y").select("doc_id")
    rep = cut(across.join(several, "doc_id", "left_anti").groupBy("doc_id").agg(F.min("rep").alias("rep")))
    for end in ("a", "b"):
        near = near.join(rep.select(F.col("doc_id").alias(end), "rep"), end, "left").withColumn(end, F.coalesce("rep", end)).drop("rep")
    blocks = components(near)
    discard(met, rep)
    sizes = profile.select(F.col("doc_id").alias("node"), "n").distinct()
    while True:
        sized = blocks.join(sizes, "node").select(F.col("node").alias("doc_id"), F.col("component").alias("block"), "n")
        large = cut(sized.groupBy("block").agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("sets")).where((F.col("size") > TILE) | (F.col("sets") > TILE_SETS)))
        n_large, n_sets, size = large.agg(F.count(F.lit(1)), F.sum("sets"), F.sum("size")).first()
        if not n_large:
            break
        able = cut(linkable(docs, sized.join(_few(large.select("block"), n_large), "block"), n_sets, size, width, percent))
        n_able = able.count()
        if 10 * n_able > 9 * n_sets:
            discard(able)
            break
        met = meet(docs.join(_few(able, n_able), "doc_id", "left_semi"), n_able)
        again, before = components(met.where("kind = 0").select("a", "b")), blocks
        blocks = cut(before.join(_few(large.select(F.col("block").alias("component")), n_large), "component", "left_anti").select("node", "component").union(again))
        discard(able, met, again, before, large)
    large_blocks = _few(large.select("block", F.lit(True).alias("is_large")), n_large)
    # linked sets differ little in size: a large block falls into bands of sizes, each set in its own and the next
    band = F.floor(F.ln("n") / F.lit(math.log(100 / (percent - 1)))).cast("int")
    banded = sized.join(large_blocks, "block", "left") if n_large else sized.withColumn("is_large", F.lit(False))
    banded = banded.select("doc_id", "block", "n", F.when(F.col("is_large"), band).otherwise(F.lit(0)).alias("home"), F.explode(F.when(F.col("is_large"), F.array(band, band + 1)).otherwise(F.array(F.lit(0)))).alias("band"))
    # what no set has for its own band has been searched one band below
    bands = banded.groupBy("block", "band").agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("sets"), F.max("home").alias("home")).where("sets > 1 and home = band").drop("home")
    members = cut(banded.join(bands, ["block", "band"]).select("doc_id", "n", "block", "band", F.ceil(F.greatest(F.col("size") / TILE, F.col("sets") / TILE_SETS)).cast("int").alias("tiles")))
    discard(blocks, large)
    n_members = members.count()
    held = docs.join(_few(members, n_members), "doc_id").select("doc_id", "n", "block", "band", "tiles", "text").mapInArrow(_set_blobs(width), "doc_id long, n long, block long, band int, tiles int, blob binary")
    held = held.where(F.length("blob") == 8 * F.col("n"))  # of an id's several texts the one meant
    held = held.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.col("tiles")).cast("int"))
    part = F.pmod(F.xxhash64("block", "band", "i", "j"), F.lit(max(8, n_members // 256)))

    def search(held: DataFrame) -> DataFrame:
        return held.withColumn("part", part).groupBy("part").applyInArrow(_search(percent), "a long, b long")

    links, spent = search(held.where("tiles = 1").select("doc_id", "block", "band", "blob", F.lit(0).alias("i"), F.lit(0).alias("j"))), []
    tiles, wide = members.where("tiles > 1").agg(F.max("tiles"), F.sum("n")).first() if n_large else (None, None)
    if tiles:
        # rounds keep the copies on disk few: what one has shuffled is deleted before the next
        whole = profile.agg(F.sum("n")).first()[0]
        parts = cut(held.where("tiles > 1"))
        for low, high in rounds(tiles, wide, whole):
            spent.append(cut(search(in_tiles(parts, low, high))))
            links = links.union(spent[-1])
        discard(parts)
    reached = components(links.union(copies.toDF("a", "b")))
    discard(members, across, *spent)
    out = profile.join(reached, F.col("doc_id") == F.col("node"), "left")
    own = F.when(F.col("doc_id") != NO_ID, F.col("doc_id"))
    return out.select(own.alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", own).alias("component_id"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 3 then [array_to_string(ws, ' ')]
        else list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i+2], ' ')) end) as g from w),
n as (select doc_id, count(*) as n from s group by 1),
k as (select s.doc_id, g, row_number() over (partition by s.doc_id order by df, g) as r, n from s join (select g, count(*) as df from s group by 1) using (g) join n on s.doc_id = n.doc_id),
c as (select distinct a.doc_id as a, b.doc_id as b from k a join k b on a.g = b.g and a.doc_id < b.doc_id
      where a.r <= a.n - (90 * a.n + 99) // 100 + 1 and b.r <= b.n - (90 * b.n + 99) // 100 + 1 and 10 * a.n >= 9 * b.n and 10 * b.n >= 9 * a.n),
o as (select c.a, c.b, count(*) as i from c join s x on x.doc_id = c.a join s y on y.doc_id = c.b and x.g = y.g group by 1, 2),
l as (select o.a, o.b from o join n na on na.doc_id = o.a join n nb on nb.doc_id = o.b where 100 * i >= 90 * (na.n + nb.n - i)),
e as (select a, b from l union all select b, a from l),
r as (select doc_id, doc_id as c from documents union select e.b, r.c from r join e on e.a = r.doc_id)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, m.c as component_id
from w left join n on w.doc_id = n.doc_id join (select doc_id, min(c) as c from r group by 1) m on m.doc_id = w.doc_id
"""
