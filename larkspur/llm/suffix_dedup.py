"""Exact removal of repeated byte strings by prefix-free parsing.

Rolling-hash triggers (window minima, so every string of the given length holds one) cut each document into phrases
that overlap in their trigger. All that a trigger decides about strings of `length` bytes is the pair of phrases around
it, cut to that depth: the left one ending in the trigger, the right one starting with it. Pairs equal to one in an
earlier document settle at once, by hash. The rest, those whose trigger other documents have too, go by trigger to
shards; there the phrases' dictionary is put in suffix order with its common-prefix lengths, and the ranks of a left and
a right phrase combine into the order of all the corpus strings through their trigger, equal strings side by side.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import Chunk, U, group_counts, mix, pack, spans, table, unpack

LENGTH = 50
TRIGGER = 20
NO_ID = (1 << 63) - 1


def slide(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over each run of that many elements, by doubling; element i covers i .. i + width - 1."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = op(x[:-step], x[step:])
        have += step
    return x


class Parse:
    """The triggers of a group of documents: position of each in its chunk and what lies around it."""

    def __init__(self, texts: list[bytes], length: int, width: int):
        self.parts: list[tuple[Chunk, int, np.ndarray, np.ndarray]] = []
        grams, contexts, docs, lefts, rights = [], [], [], [], []
        for i, j in spans(texts):
            c = Chunk(texts[i:j])
            at, doc = triggers(c, length, width)
            s = np.maximum(at - (length - width), c.starts[doc])
            e = np.minimum(at + length, c.ends[doc])
            grams.append(c.hash(at, at + width))
            contexts.append(mix(c.hash(s, e) + (at - s).astype(U)))
            lefts.append(at - s)
            rights.append(e - at)
            docs.append(doc + i)
            self.parts.append((c, i, at, doc))
        cat = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
        self.gram, self.context, self.doc = cat(grams, U), cat(contexts, U), cat(docs, np.int64)
        self.left, self.right = cat(lefts, np.int64), cat(rights, np.int64)


def triggers(c: Chunk, length: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose rolling hash is the least of some window inside one document, and their documents."""
    span = length - width + 1
    n = len(c.buf) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.arange(len(c.buf) - width + 1)
    rolling = (c.hash(at, at + width) >> U(33)).astype(np.uint32) + np.uint32(1)
    least = slide(rolling, span, np.minimum)
    inside = np.zeros(len(c.buf) + 1, np.int32)
    room = np.maximum(c.ends - c.starts - length + 1, 0)
    np.add.at(inside, c.starts, room > 0)
    np.add.at(inside, c.starts + room, -1 * (room > 0))
    least[np.cumsum(inside)[: len(least)] == 0] = 0
    padded = np.concatenate([np.zeros(span - 1, np.uint32), least, np.zeros(span - 1, np.uint32)])
    hit = np.flatnonzero(slide(padded, span, np.maximum)[: len(rolling)] == rolling)
    return hit, np.searchsorted(c.starts, hit, "right") - 1


def in_order(t: pa.Table) -> tuple[list[int], list[bytes], np.ndarray]:
    """A group's rows in an order that every stage finds again: ids (null last), texts as bytes, and the row numbers."""
    ids = [NO_ID if x is None else x for x in t["doc_id"].to_pylist()]
    texts = [x or b"" for x in t["text"].cast(pa.large_binary()).to_pylist()]
    order = sorted(range(len(ids)), key=lambda r: (ids[r], texts[r]))
    return [ids[r] for r in order], [texts[r] for r in order], np.array(order, np.int64)


def settled_here(p: Parse, ids: np.ndarray) -> np.ndarray:
    """Triggers whose surroundings an earlier document of the same group has too."""
    doc = ids[p.doc]
    order = np.lexsort((doc, p.context, p.gram))
    g, c, d = p.gram[order], p.context[order], doc[order]
    head = np.append(True, (g[1:] != g[:-1]) | (c[1:] != c[:-1])) if len(g) else np.zeros(0, bool)
    out = np.zeros(len(g), bool)
    out[order] = d != d[head][np.cumsum(head) - 1] if len(g) else out
    return out


ROWS = "bucket int, gid long, kind int, blob binary"


def _rows(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [[], [], [], []]
    return pa.table({n: pa.array(list(x), k) for n, x, k in zip(("bucket", "gid", "kind", "blob"), cols, (pa.int32(), pa.int64(), pa.int32(), pa.binary()), strict=True)})


def _deal(to: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(to, kind="stable")
    cuts = np.searchsorted(to[order], np.arange(buckets + 1))
    for b in range(buckets):
        if cuts[b] < cuts[b + 1]:
            yield b, order[cuts[b] : cuts[b + 1]]


def _phrases(length: int, width: int, buckets: int):
    def run(t: pa.Table) -> pa.Table:
        ids, texts, _ = in_order(t)
        p, gid, ids = Parse(texts, length, width), t["gid"][0].as_py(), np.array(ids, np.int64)
        at = np.flatnonzero(~settled_here(p, ids))
        out = []
        for b, x in _deal((p.gram[at] >> U(13)) % U(buckets), buckets):
            x = np.sort(at[x])
            docs, where = np.unique(ids[p.doc[x]], return_inverse=True)
            out.append((b, gid, 0, pack(p.gram[x], p.context[x], docs, np.diff(where, prepend=0).astype(np.int16 if len(docs) < 1 << 15 else np.int32), np.diff(x, prepend=0).astype(np.uint32))))
        return _rows(out)

    return run


def _dictionary(t: pa.Table) -> pa.Table:
    """Tells each group which triggers are settled and which need the order of what surrounds them."""
    gids, parts = t["gid"].to_pylist(), [unpack(x) for x in t["blob"].to_pylist()]
    gram = np.concatenate([x[0] for x in parts])
    context = np.concatenate([x[1] for x in parts])
    docs = np.concatenate([x[2][np.cumsum(x[3], dtype=np.int64)] for x in parts])
    mark = np.concatenate([np.cumsum(x[4], dtype=np.int64) for x in parts])
    of = np.repeat(np.arange(len(parts)), [len(x[0]) for x in parts])
    order = np.lexsort((docs, context, gram))
    g, c, d = gram[order], context[order], docs[order]
    new_gram = np.append(True, g[1:] != g[:-1])
    head = np.append(True, (g[1:] != g[:-1]) | (c[1:] != c[:-1]))
    settled = d != d[head][np.cumsum(head) - 1]
    # of the rest: triggers that two documents or more have
    starts = np.flatnonzero(new_gram)
    last = np.iinfo(np.int64)
    low = np.minimum.reduceat(np.where(settled, last.max, d), starts)
    high = np.maximum.reduceat(np.where(settled, last.min, d), starts)
    open_ = (low < high)[np.cumsum(new_gram) - 1] & ~settled
    of, mark = of[order], mark[order]
    out = []
    for k, gid in enumerate(gids):
        mine = of == k
        out.append((0, gid, 0, pack(np.sort(mark[mine & settled]), np.sort(mark[mine & open_]))))
    return _rows(out)


def _contexts(length: int, width: int, buckets: int):
    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _rows([])
        ids, texts, _ = in_order(docs)
        p, gid, ids = Parse(texts, length, width), docs["gid"][0].as_py(), np.array(ids, np.int64)
        told = [unpack(x) for x in replies["blob"].to_pylist()]
        none = [np.zeros(0, np.int64)]
        settled = np.sort(np.concatenate([x[0] for x in told] + none))
        at = np.sort(np.concatenate([x[1] for x in told] + none))
        out = [(gid % buckets, gid, 1, pack(np.diff(settled, prepend=0).astype(np.uint32)))]
        first, lines = 0, []
        for c, _, pos, _ in p.parts:
            mine = at[(at >= first) & (at < first + len(pos))] - first
            # the bytes around each trigger; those beyond the document are set to nought
            around = np.arange(width - length, length)
            x = pos[mine][:, None] + around
            line = c.buf[np.clip(x, 0, len(c.buf) - 1)]
            line[(around < -p.left[first + mine][:, None]) | (around >= p.right[first + mine][:, None])] = 0
            lines.append(line)
            first += len(pos)
        whole = np.concatenate(lines) if lines else np.zeros((0, 2 * length - width), np.uint8)
        for b, x in _deal((p.gram[at] >> U(13)) % U(buckets), buckets):
            y = at[x]
            out.append((b, gid, 0, pack(ids[p.doc[y]], y.astype(np.uint32), p.left[y].astype(np.uint8), p.right[y].astype(np.uint8), np.ascontiguousarray(whole[x]).ravel())))
        return _rows(out)

    return run


def suffix_order(lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rank of each byte line, and for each rank how many bytes it shares with the rank before."""
    n, width = lines.shape
    words = np.zeros((n, -(-width // 8) * 8), np.uint8)
    words[:, :width] = lines
    words = words.view(">u8").astype(U)
    order = np.lexsort(words.T[::-1])
    same = lines[order[1:]] == lines[order[:-1]]
    common = np.zeros(n, np.int64)
    common[1:] = np.where(same.all(1), width, np.argmin(same, 1))
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    return rank, common


def repeated_strings(docs: np.ndarray, left: np.ndarray, right: np.ndarray, lines: np.ndarray, length: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, o): the string that starts o bytes before the line's trigger also starts in an earlier document."""
    reach = length - width
    rank_r, common_r = suffix_order(lines[:, reach:])
    rank_l, common_l = suffix_order(np.ascontiguousarray(lines[:, length - 1 :: -1]))
    hits, offsets = [], []
    for o in range(reach + 1):
        at = np.flatnonzero((left >= o) & (right >= length - o))
        if len(at) < 2:
            continue
        class_r = np.cumsum(common_r < length - o)[rank_r[at]]
        class_l = np.cumsum(common_l < width + o)[rank_l[at]]
        key = class_l * (len(docs) + 1) + class_r
        order = np.lexsort((docs[at], key))
        k, d = key[order], docs[at][order]
        head = np.append(True, k[1:] != k[:-1])
        late = at[order[d != d[head][np.cumsum(head) - 1]]]
        hits.append(late)
        offsets.append(np.full(len(late), o))
    none = np.zeros(0, np.int64)
    return np.concatenate([*hits, none]), np.concatenate([*offsets, none])


def _order(length: int, width: int):
    def run(t: pa.Table) -> pa.Table:
        out, gids, parts = [], [], []
        for gid, kind, blob in zip(t["gid"].to_pylist(), t["kind"].to_pylist(), t["blob"].to_pylist(), strict=True):
            if kind:
                out.append((0, gid, 1, blob))
            else:
                gids.append(gid)
                parts.append(unpack(blob))
        if parts:
            docs, mark, left, right, flat = (np.concatenate([x[k] for x in parts]) for k in range(5))
            of = np.repeat(np.arange(len(parts)), [len(x[0]) for x in parts])
            hit, o = repeated_strings(docs, left, right, flat.reshape(len(docs), 2 * length - width), length, width)
            for k, gid in enumerate(gids):
                mine = of[hit] == k
                if mine.any():
                    out.append((0, gid, 0, pack(mark[hit[mine]].astype(np.int64), o[mine].astype(np.uint8))))
        return _rows(out)

    return run


def covered_bytes(texts: list[bytes], ids: np.ndarray, replies: list[tuple[int, list[np.ndarray]]], length: int, width: int) -> Iterator[tuple[bytes, np.ndarray]]:
    """Each text with a flag for each byte: removed or not."""
    p = Parse(texts, length, width)
    none = [np.zeros(0, np.int64)]
    settled = np.concatenate([np.cumsum(x[0], dtype=np.int64) for k, x in replies if k] + [np.flatnonzero(settled_here(p, ids))])
    mark = np.concatenate([x[0] for k, x in replies if not k] + none)
    back = np.concatenate([x[1].astype(np.int64) for k, x in replies if not k] + none)
    first = 0
    for c, i, pos, _ in p.parts:
        edge = np.zeros(len(c.buf) + 1, np.int32)
        s = settled[(settled >= first) & (settled < first + len(pos))]
        most = np.minimum(p.left[s], length - width)
        least = np.maximum(0, length - p.right[s])
        at = pos[s - first]
        np.add.at(edge, at - most, 1)
        np.add.at(edge, at - least + length, -1)
        m = (mark >= first) & (mark < first + len(pos))
        at = pos[mark[m] - first] - back[m]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + length, -1)
        flags = np.cumsum(edge[:-1]) > 0
        first += len(pos)
        for k, (b, e) in enumerate(zip(c.starts, c.ends, strict=True)):
            yield texts[i + k], flags[b:e]


def whole_characters(text: bytes, gone: np.ndarray) -> str:
    """What is left if only characters go all of whose bytes are removed."""
    buf = np.frombuffer(text, np.uint8)
    begin = np.flatnonzero((buf & 0xC0) != 0x80)
    if not len(begin):
        return text.decode("utf-8", "replace")
    keep = ~np.minimum.reduceat(gone, begin)
    return buf[np.repeat(keep, np.diff(np.append(begin, len(buf))))].tobytes().decode("utf-8", "replace")


def _apply(length: int, width: int, keys: list[str]):
    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        ids, texts, order = in_order(docs)
        told = list(zip(replies["kind"].to_pylist(), map(unpack, replies["blob"].to_pylist()), strict=True))
        out: list[tuple] = []
        for text, gone in covered_bytes(texts, np.array(ids, np.int64), told, length, width) if texts else ():
            buf = np.frombuffer(text, np.uint8)
            n_spans = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
            out.append((len(buf), int(gone.sum()), n_spans, hashlib.sha256(buf[~gone].tobytes()).hexdigest(), whole_characters(text, gone) if n_spans else text.decode("utf-8", "replace")))
        cols = list(zip(*out, strict=True)) or [[]] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        own = docs.take(pa.array(order)).select(keys)
        for name, x, kind in zip(("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"), cols, kinds, strict=True):
            own = own.append_column(name, pa.array(list(x), kind))
        return own

    return run


def dedup(docs: DataFrame, length: int = LENGTH, width: int = TRIGGER, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the text, with n_bytes, n_removed, n_spans, kept_sha256 and kept_text.

    A byte goes if a string of `length` bytes over it also starts in a document with a smaller id. kept_sha256 is of the
    bytes left; kept_text drops only whole characters. Null text: as empty. Null id: after all others, compared with
    them but not with one another. Rows with one id don't count against each other. Empty table: empty result. Columns
    of docs named like a result column are replaced.
    """
    docs = docs.drop("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "gid")
    docs = docs.withColumnsRenamed({doc_id: "doc_id", text: "text"})
    keys = [f for f in docs.schema.fields if f.name != "text"]
    groups, buckets = group_counts(docs)
    # all three uses of the documents have the same columns, so that Spark shuffles the texts once and reads that again
    dealt = docs.withColumn("gid", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)))
    asked = dealt.groupBy("gid").applyInArrow(_phrases(length, width, buckets), ROWS)
    told = asked.groupBy("bucket").applyInArrow(_dictionary, ROWS)
    around = dealt.groupBy("gid").cogroup(told.groupBy("gid")).applyInArrow(_contexts(length, width, buckets), ROWS)
    ordered = around.groupBy("bucket").applyInArrow(_order(length, width), ROWS)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keys), "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"])
    return dealt.groupBy("gid").cogroup(ordered.groupBy("gid")).applyInArrow(_apply(length, width, [f.name for f in keys]), schema)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept_text")


OP2_SQL = r"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
k as (select doc_id, len(h) // 2 as n, k, substring(h, 1000 * k + 1, 1098) as c from (select doc_id, h, unnest(range(0, (len(h) // 2 + 499) // 500)) as k from d)),
p as (select doc_id, 500 * k + j as i, n, substring(c, 2 * j + 1, 2) as b, substring(c, 2 * j + 1, 100) as g from (select *, unnest(range(0, least(500, n - 500 * k))) as j from k)),
s as (select doc_id, i, g from p where i + 50 <= n),
m as (select doc_id, i, min(doc_id) over (partition by g) as first from s),
x as (select doc_id, i, max(i) over (partition by doc_id order by i rows between unbounded preceding and current row) as last from m where first < doc_id),
f as (select p.doc_id, p.i, b,
        coalesce(p.i - max(x.i) over (partition by p.doc_id order by p.i rows between unbounded preceding and current row) < 50, false) as gone
      from p left join x on x.doc_id = p.doc_id and x.i = p.i),
e as (select *, gone and not coalesce(lag(gone) over (partition by doc_id order by i), false) as opens from f),
a as (select doc_id, sum(gone::int)::bigint as n_removed, sum(opens::int)::bigint as n_spans, coalesce(string_agg(b, '' order by i) filter (where not gone), '') as kept from e group by 1)
select d.doc_id, (len(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(kept, ''))) as kept_sha256
from d left join a on a.doc_id = d.doc_id
"""
