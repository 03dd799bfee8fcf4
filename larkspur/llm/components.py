"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import cut, discard

#: Nodes that a task holds before it passes on the forest it has, at the next upper end.
HELD = 1_000_000
#: Inner nodes that are broadcast at most, some 40 bytes each; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 500_000


def _forests(held: int):
    """Edges (a, b), a > b, as edges from each node to the least node it reaches among the edges of this task; edges of one
    upper end that come one after another always count together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def find(x: int) -> int:
            while (y := up[x]) != x:
                up[x] = x = up[y]
            return x

        def out() -> Iterator[pa.RecordBatch]:
            found = [(x, r) for x in up if (r := find(x)) != x]
            for i in range(0, len(found), 10_000):
                a, b = zip(*found[i : i + 10_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        last = None
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if a != last and len(up) > held:
                    yield from out()
                    up.clear()
                last = a
                up.setdefault(a, a)
                up.setdefault(b, b)
                a, b = find(a), find(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
        yield from out()

    return run


def components(edges: DataFrame, a: str = "a", b: str = "b", held: int = HELD) -> DataFrame:
    """(node, component): the smallest id reachable from each id that occurs in an edge.

    Each task first contracts the edges it has. Then each round points every edge at the least neighbour of its lower
    end (large star), deals the edges by their upper end and contracts what meets there (small star), until every node
    has one edge, to a node without a lower neighbour. Edges stay in the cluster, each round is written to the checkpoint
    folder in place of the last, and the rounds grow with the logarithm of the longest path. Only lower ends that have a
    lower neighbour are joined, so the centres of large stars, which have none, gather nowhere; the minima are partial
    aggregates, and a contracted task passes on one edge a node at most. Loops and null ends are ignored; no edges: empty
    result.
    """
    big, small = F.greatest(F.col(a), F.col(b)).alias("a"), F.least(F.col(a), F.col(b)).alias("b")
    real = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(big.cast("long"), small.cast("long"))
    now = cut(real.mapInArrow(_forests(held), "a long, b long"))
    while True:
        lower = now.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("low"), F.count(F.lit(1)).alias("n"))
        inner = cut(lower.join(now.select(F.col("b").alias("k")).distinct(), "k", "left_semi").select("k", "low"))
        n_inner = inner.count()
        if not n_inner and not lower.where("n > 1").limit(1).count():
            discard(inner)
            break
        few = F.broadcast(inner) if n_inner <= BROADCAST_ROWS else inner
        large = now.join(few, now["b"] == inner["k"], "left").select("a", F.coalesce("low", "b").alias("b"))
        before, now = now, cut(large.repartition("a").sortWithinPartitions("a").mapInArrow(_forests(held), "a long, b long"))
        discard(before, inner)
    out = now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b"), F.col("b")).distinct())
    out.stored_at = now.stored_at
    return out
