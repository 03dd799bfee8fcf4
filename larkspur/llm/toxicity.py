"""Toxicity by nearest labelled examples.

All terms of a bounded sample of labelled examples span a TF-IDF space, each term weighed by how far it goes with the
label (its squared phi coefficient on the examples). A text's nearest examples by exact cosine come from an inverted index whose
lists are cut into blocks of examples: the blocks' largest weights bound their scores, the blocks of largest bound are
read first, then all those whose bound still reaches the nearest found, and no other. Distance-weighted votes are
calibrated on the examples themselves, each left out of its own search.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import TERM_BYTE, U, Chunk, as_bytes, cut, fold, owners, pack, spans, table, unpack

#: The learning sample: at most so many labelled rows of each label, those whose ids hash lowest.
EXAMPLES = 1000
NEIGHBOURS, BLOCK = 25, 64
#: Blocks that are read before the others' bounds are held against what was found.
FIRST = 4


def term_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term hash, count) of all terms: runs of letters and digits, A-Z in lower case."""
    words, bounds = Chunk(texts, lower=True, word_byte=TERM_BYTE).word_hashes()
    doc = owners(bounds).astype(U)
    order = np.lexsort((words, doc))
    w, d = words[order], doc[order]
    head = np.flatnonzero(np.append(True, (w[1:] != w[:-1]) | (d[1:] != d[:-1]))) if len(w) else np.zeros(0, np.int64)
    return d[head].astype(np.int64), w[head], np.diff(np.append(head, len(w)))


def known_terms(texts: list[bytes], terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, position in terms, count) of all terms that are among the sorted `terms`."""
    d, t, n = term_counts(texts)
    if not len(terms):
        return d[:0], d[:0], n[:0]
    at = np.minimum(np.searchsorted(terms, t), len(terms) - 1)
    hit = terms[at] == t
    return d[hit], at[hit], n[hit]


def unit(d: np.ndarray, p: np.ndarray, n: np.ndarray, factor: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """The weights of unit vectors, and where each document's begin (one entry more than documents)."""
    w = (1 + np.log(n)) * factor[p]
    norm = np.sqrt(np.bincount(d, weights=w * w, minlength=docs))
    return w / np.maximum(norm[d], 1e-12), np.searchsorted(d, np.arange(docs + 1))


def document_frequency(docs: DataFrame, terms: np.ndarray) -> np.ndarray:
    """How many of all documents have each of the terms; the last entry counts the documents with any of them."""
    held = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(held.value) + 1, np.int64)
        for b in batches:
            texts = as_bytes(b.column(0))
            for i, j in spans(texts):
                d, p, _ = known_terms(texts[i:j], held.value)
                total[:-1] += np.bincount(p, minlength=len(held.value))
                total[-1] += len(np.unique(d))
        at = np.flatnonzero(total)
        for i in range(0, len(at), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[i : i + 10_000]), pa.array(total[at[i : i + 10_000]])], ["p", "n"])

    # as many rows as the examples have terms
    rows = docs.select("text").mapInArrow(run, "p long, n long").groupBy("p").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(terms) + 1, np.int64)
    out[rows["p"].to_numpy()] = rows["n"].to_numpy()
    return out


def ranges(s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """All integers of the ranges [s, e), one after another."""
    n = e - s
    stop = np.cumsum(n)
    return np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(s - (stop - n), n)


class BlockMaxIndex:
    """Postings in the order of term and example; for each term and block of BLOCK examples an entry with where its
    postings begin and the largest weight among them."""

    def __init__(self, ex: np.ndarray, term: np.ndarray, w: np.ndarray, n: int, n_terms: int):
        self.n, self.blocks = n, max(1, -(-n // BLOCK))
        order = np.lexsort((ex, term))
        self.ex, self.w, term = ex[order], w[order], term[order]
        key = term * self.blocks + self.ex // BLOCK
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        self.begin = np.append(head, len(key))
        self.block = key[head] % self.blocks
        self.most = np.maximum.reduceat(self.w, head) if len(head) else np.zeros(0)
        self.entry = np.searchsorted(key[head], np.arange(n_terms + 1) * self.blocks)

    def nearest(self, p: np.ndarray, w: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of largest cosine above 0 (ties: the first ones) and the cosines, by falling cosine."""
        s, e = self.entry[p], self.entry[p + 1]
        entry, x = ranges(s, e), np.repeat(w, e - s)
        block = self.block[entry]
        bound = np.bincount(block, weights=x * self.most[entry], minlength=self.blocks)
        score = np.zeros(self.n)

        def read(blocks: np.ndarray) -> None:
            at = np.flatnonzero(blocks[block])
            s, e = self.begin[entry[at]], self.begin[entry[at] + 1]
            post = ranges(s, e)
            np.add(score, np.bincount(self.ex[post], weights=self.w[post] * np.repeat(x[at], e - s), minlength=self.n), out=score)
            if skip >= 0:
                score[skip] = 0

        first = np.zeros(self.blocks, bool)
        first[np.argsort(-bound, kind="stable")[:FIRST]] = True
        read(first)
        least = np.partition(score, self.n - k)[self.n - k] if self.n > k else 0.0
        rest = ~first & (bound > 0) & (bound >= least - 1e-12)
        if rest.any():
            read(rest)
        at = np.flatnonzero(score > 0)
        if len(at) > k:
            at = at[score[at] >= np.partition(score[at], len(at) - k)[len(at) - k]]
        at = at[np.lexsort((at, -score[at]))[:k]]
        return at, score[at]


class Model:
    """Terms, their factors, the indexed examples with labels and ids, and the votes' calibration.

    share: how many learning rows an example of each label stands for; its vote weighs as many.
    """

    def __init__(self, terms: np.ndarray, factor: np.ndarray, d: np.ndarray, p: np.ndarray, n: np.ndarray, labels: list[int], ids: list[int], share: dict[int, float]):
        self.terms, self.factor, self.labels, self.ids = terms, factor, np.array(labels, np.float64), ids
        w, edge = unit(d, p, n, factor, len(ids))
        self.index = BlockMaxIndex(d, p, w, len(ids), len(terms))
        self.weight = np.where(self.labels == 1, share[1], share[0])
        votes = [self.vote(p[edge[i] : edge[i + 1]], w[edge[i] : edge[i + 1]], skip=i)[0] for i in range(len(ids))]
        known = np.array([v is not None for v in votes])
        y, wt = self.labels, self.weight
        none = ~known
        self.blank = float((y[none] * wt[none]).sum() + (y * wt).sum() / wt.sum()) / float(wt[none].sum() + 1)
        self.slope, self.shift = _platt(np.array([v if v is not None else 0.5 for v in votes])[known], y[known], wt[known])

    def vote(self, p: np.ndarray, w: np.ndarray, skip: int = -1) -> tuple[float | None, np.ndarray, np.ndarray]:
        who, cosine = self.index.nearest(p, w, NEIGHBOURS, skip)
        if not len(who):
            return None, who, cosine
        near = self.weight[who] / np.maximum(1 - cosine, 0.02)
        return float((near * self.labels[who]).sum() / near.sum()), who, cosine

    def score(self, texts: list[bytes]) -> tuple[list[float], list[list[int]]]:
        """Each text's calibrated score, and the ids of its three nearest examples."""
        d, p, n = known_terms(texts, self.terms)
        w, edge = unit(d, p, n, self.factor, len(texts))
        scores, evidence = [], []
        for s, e in zip(edge[:-1], edge[1:], strict=True):
            v, who, _ = self.vote(p[s:e], w[s:e])
            scores.append(self.blank if v is None else float(1 / (1 + np.exp(-(self.slope * _logit(v) + self.shift)))))
            evidence.append([self.ids[i] for i in who[:3]])
        return scores, evidence


def _logit(v):
    v = np.clip(v, 0.01, 0.99)
    return np.log(v / (1 - v))


def _platt(votes: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through the votes' log odds, by Newton's method with a small penalty."""
    if not len(votes):
        return 1.0, 0.0
    x = np.stack([_logit(votes), np.ones(len(votes))], 1)
    b = np.array([1.0, 0.0])
    for _ in range(50):
        q = 1 / (1 + np.exp(-x @ b))
        g = x.T @ (w * (y - q)) - 1e-3 * (b - [1, 0])
        h = (x * (w * q * (1 - q) + 1e-9)[:, None]).T @ x + 1e-3 * np.eye(2)
        move = np.linalg.solve(h, g)
        b = b + np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-9:
            break
    return max(float(b[0]), 1e-3), float(b[1])


def label_factor(d: np.ndarray, p: np.ndarray, labels: np.ndarray, n_terms: int) -> np.ndarray:
    """Each term's squared phi coefficient with the label over the examples (0 to 1)."""
    n, ones = len(labels), labels.sum()
    have = np.bincount(p, minlength=n_terms).astype(float)
    a = np.bincount(p, weights=labels[d], minlength=n_terms)
    spread = have * (n - have) * ones * (n - ones)
    return (n * a - have * ones) ** 2 / np.maximum(spread, 1.0)


def learn(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> Model | None:
    """Fits a model: docs has (doc_id, text), labels (doc_id, toxic).

    The examples are a bounded sample, at most `examples` rows of each label; all their terms count. idf counts all of
    docs. None if a label is missing. Null and empty texts are examples without terms. An id with two labels counts as
    two rows, and so does one with two texts. Empty tables: None.
    """
    known = labels.select("doc_id", "toxic").distinct()
    ids = cut(reduce(DataFrame.union, (known.where(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples) for v in (0, 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, out = as_bytes(b.column(2)), []
            for i, j in spans(texts):
                d, t, n = term_counts(texts[i:j])
                edge = np.searchsorted(d, np.arange(j - i + 1))
                out += [pack(t[s:e], n[s:e].astype(np.uint32)) for s, e in zip(edge[:-1], edge[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["doc_id", "toxic", "terms"])

    # at most twice `examples` ids are broadcast, and so many rows come to the driver
    rows = docs.join(F.broadcast(ids), "doc_id").select("doc_id", "toxic", "text").mapInArrow(run, "doc_id long, toxic int, terms binary").collect()
    rows = sorted((r.doc_id, r.toxic, bytes(r.terms)) for r in rows)
    if {r[1] for r in rows} != {0, 1}:
        return None
    parts = [unpack(r[2]) for r in rows]
    d = np.repeat(np.arange(len(rows)), [len(t) for t, _ in parts])
    n = np.concatenate([c for _, c in parts])
    terms, p = np.unique(np.concatenate([t for t, _ in parts]), return_inverse=True)
    df = document_frequency(docs, terms)
    factor = np.log(1 + df[-1] / np.maximum(df[:-1], 1)) * label_factor(d, p, np.array([r[1] for r in rows], float), len(terms))
    # like by like, for tight bounds: by the examples' heaviest terms
    w = (1 + np.log(n)) * factor[p]
    order = np.lexsort((-w, d))
    edge = np.searchsorted(d, np.arange(len(rows) + 1))
    like = sorted(range(len(rows)), key=lambda i: (p[order[edge[i] : min(edge[i] + 3, edge[i + 1])]].tolist(), i))
    at = np.concatenate([np.arange(edge[i], edge[i + 1]) for i in like])
    d = np.repeat(np.arange(len(rows)), [edge[i + 1] - edge[i] for i in like])
    rows = [rows[i] for i in like]
    counts = {r[0]: r[1] for r in labels.groupBy("toxic").count().collect()}
    share = {v: counts.get(v, 0) / max(1, sum(r[1] == v for r in rows)) for v in (0, 1)}
    return Model(terms, factor, d, p[at], n[at], [r[1] for r in rows], [r[0] for r in rows], share)


def rate(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs without the text, with score (0 to 1), predicted and evidence (ids of the nearest examples).

    Null or empty texts, and texts without any term of the examples, get the share of label 1 among such examples.
    Without a model every score is 0. Columns of docs named like a result are replaced. Empty table: empty result.
    """
    docs = docs.drop("score", "predicted", "evidence")
    keep = [f for f in docs.schema.fields if f.name != text]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "score double, predicted int, evidence array<bigint>"])
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model | None = held.value
        for b in batches:
            texts = as_bytes(b.column(b.num_columns - 1))
            scores, evidence = [], []
            for i, j in spans(texts):
                s, e = m.score(texts[i:j]) if m else ([0.0] * (j - i), [[]] * (j - i))
                scores += s
                evidence += e
            s = np.array(scores, np.float64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(evidence, pa.list_(pa.int64()))], [*b.schema.names[:-1], "score", "predicted", "evidence"])

    return docs.select(*(F.col(f"`{f.name}`") for f in keep), F.col(text)).mapInArrow(run, schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where("toxic in (0, 1) and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    model = learn(docs, labels.where(fold() != 0))
    return rate(docs.withColumn("held_out", F.coalesce(fold() == 0, F.lit(False))), model).select("doc_id", "held_out", "score", "predicted", "evidence")
