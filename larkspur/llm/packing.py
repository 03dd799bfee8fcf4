"""Best-fit packing of documents into training sequences under conflicts.

Open bins are kept in order of what room they have left, each with a bitmap of its sources and one of its duplicate
clusters. A piece goes to the tightest bin that holds it and has neither its source nor its cluster yet: the search
starts at the first bin with room enough and goes on to the successor until a compatible one is found.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ngram_join import linked
from .textkit import Chunk, as_bytes, spans, table

CAPACITY = 2048
#: Near duplicates share that many percent of their shingles of so many words.
NEAR_WIDTH, NEAR_PERCENT = 5, 80
#: Documents of a shard, about; each shard is packed by one task from ids and sizes alone.
SHARD = 4096


class Packer:
    """Bins of one shard. Bins are numbered in the order they open."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.open: list[tuple[int, int]] = []  # (room left, bin)
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self._bits: tuple[dict, dict] = {}, {}

    def _bit(self, kind: int, value) -> int:
        """The bitmap with the value's bit alone; null conflicts with nothing."""
        return 0 if value is None else 1 << self._bits[kind].setdefault(value, len(self._bits[kind]))

    def put(self, size: int, source, cluster) -> tuple[int, int]:
        """(bin, offset in it)."""
        s, c = self._bit(0, source), self._bit(1, cluster)
        for k in range(bisect_left(self.open, (size, -1)), len(self.open)):
            room, b = self.open[k]
            if not (self.sources[b] & s or self.clusters[b] & c):
                del self.open[k]
                break
        else:
            room, b = self.capacity, len(self.sources)
            self.sources.append(0)
            self.clusters.append(0)
        self.sources[b] |= s
        self.clusters[b] |= c
        if room > size:
            insort(self.open, (room - size, b))
        return b, self.capacity - room


def pack_shard(rows: list[tuple], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(row, piece, start, size, bin, offset) for rows of (id, size, source, cluster), by falling piece size.

    What exceeds the capacity is cut: full pieces fill bins of their own, the rest is packed. Size 0 takes part too.
    """
    packer, pieces = Packer(capacity), []
    for r, (_, size, _, _) in enumerate(rows):
        for k in range(max(1, -(-size // capacity))):
            pieces.append((r, k, k * capacity, min(capacity, size - k * capacity)))
    pieces.sort(key=lambda p: (-p[3], rows[p[0]][0] is None, rows[p[0]][0] or 0, rows[p[0]][3] or 0, p[1]))
    return [(*p, *packer.put(p[3], rows[p[0]][2], rows[p[0]][3])) for p in pieces]


def pack(docs: DataFrame, capacity: int = CAPACITY, doc_id: str = "doc_id", size: str = "size", source: str = "source", cluster: str = "cluster", shard: int = SHARD) -> DataFrame:
    """(doc_id, piece, start, size, bin_id, bin_offset): where each document's pieces lie.

    No bin has two pieces of one source or of one duplicate cluster. bin_id is the shard's number and the bin's within
    it. Shards come from a hash of id and cluster, so a hot source or a large cluster is spread over all of them. Null
    or negative size counts as 0, null source or cluster conflicts with nothing, rows with one id are packed singly.
    Empty table: empty result.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long").alias("size"), F.col(source).cast("string").alias("source"), F.col(cluster).cast("long").alias("cluster"))
    shards = max(1, -(-rows.count() // shard))

    def run(t: pa.Table) -> pa.Table:
        c = t.to_pydict()
        items = sorted(zip(c["doc_id"], c["size"], c["source"], c["cluster"], strict=True), key=lambda r: tuple((x is None, x or type(x)()) if x is not None else (True, 0) for x in r))
        found = pack_shard(items, capacity)
        cols = list(zip(*((items[r][0], k, start, n, c["shard"][0] << 32 | b, offset) for r, k, start, n, b, offset in found), strict=True))
        return pa.table({n: pa.array(list(x), pa.int64()) for n, x in zip(("doc_id", "piece", "start", "size", "bin_id", "bin_offset"), cols, strict=True)})

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(run, "doc_id long, piece long, start long, size long, bin_id long, bin_offset long")


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text, the last column, gives way to its number of words; null has none."""
    for b in batches:
        texts = as_bytes(b.column(3))
        counts = [np.diff(Chunk(texts[i:j]).words()[2]) for i, j in spans(texts)]
        size = pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64), pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), size, b.column(2)], ["doc_id", "source", "size", "key_"])


def sized(docs: DataFrame, text: str = "text", width: int = NEAR_WIDTH, percent: int = NEAR_PERCENT) -> DataFrame:
    """(doc_id, source, size, cluster): size in words, and the near-duplicate component of the text, case aside.

    Rows with one id are of one cluster, and so are all texts without words. A row without id goes by its text.
    """
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[\x20\x09-\x0D]+", " "))
    key = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(plain))
    near = linked(docs.select(key.alias("doc_id"), F.lower(text).alias("text")), width=width, percent=percent)
    near = near.where("n_shingles > 0").groupBy(F.col("doc_id").alias("key_")).agg(F.min("component_id").alias("near_"))
    kinds = T.StructType([docs.schema["doc_id"], docs.schema["source"], T.StructField("size", T.LongType()), T.StructField("key_", T.LongType())])
    rows = docs.select("doc_id", "source", key.alias("key_"), F.col(text).alias("text")).mapInArrow(_word_counts, kinds)
    return rows.join(near, "key_", "left").select("doc_id", "source", "size", F.coalesce("near_", F.xxhash64(F.lit(""))).alias("cluster"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(sized(table(spark, sf_dir, "documents")))
