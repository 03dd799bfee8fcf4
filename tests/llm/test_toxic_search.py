"""Toxicity: the block-max search against dense cosine, scores against brute force, and what labels may change."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from larkspur.llm import registry, toxicity


def test_block_max_search_is_exact():
    rng = np.random.default_rng(1)
    dense = rng.random((700, 60)) * (rng.random((700, 60)) < 0.15) * rng.random(60) ** 4
    dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-12)
    ex, term = np.nonzero(dense)
    index = toxicity.BlockMaxIndex(ex, term, dense[ex, term], 700, 60)
    for i in range(120):
        p = np.flatnonzero(dense[i])
        cosine = dense @ dense[i]
        cosine[i] = 0
        who, got = index.nearest(p, dense[i, p], 25, skip=i)
        assert np.allclose(got, np.sort(cosine[cosine > 1e-15])[::-1][:25]) and i not in who and np.allclose(cosine[who], got)
    assert len(index.nearest(np.zeros(0, np.int64), np.zeros(0), 25)[0]) == 0


@pytest.fixture(scope="module")
def small():
    rng = random.Random(6)
    docs = [(i, " ".join([rng.choice(["red", "blue", f"x{rng.randrange(50)}"]) for _ in range(30)] + (["Idiot!"] if i % 4 == 0 else []))) for i in range(200)]
    return [*docs, (200, ""), (201, None), (202, "never seen")]


def terms(t):
    return Counter(re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower()))


def brute(docs, labels):
    """Scores from dense dictionaries: weights, all cosines, the votes of the 25 nearest; uncalibrated."""
    text = dict(docs)
    known = {t for i, _ in labels for t in terms(text[i])}
    df = Counter(t for _, x in docs for t in terms(x) if t in known)
    n_docs = sum(any(t in known for t in terms(x)) for _, x in docs)
    n, ones = len(labels), sum(y for _, y in labels)

    def phi(t):
        have = [y for i, y in labels if t in terms(text[i])]
        spread = len(have) * (n - len(have)) * ones * (n - ones)
        return (n * sum(have) - len(have) * ones) ** 2 / max(spread, 1)

    factor = {t: math.log(1 + n_docs / df[t]) * phi(t) for t in known}

    def vector(x):
        v = {t: (1 + math.log(c)) * factor[t] for t, c in terms(x).items() if t in known}
        norm = math.sqrt(sum(w * w for w in v.values()))
        return {t: w / max(norm, 1e-12) for t, w in v.items()}

    examples = [(vector(text[i]), y) for i, y in labels]
    out = {}
    for d, x in docs:
        q = vector(x)
        near = sorted(((sum(w * v.get(t, 0) for t, w in q.items()), y) for v, y in examples), key=lambda r: -r[0])[:25]
        near = [(1 / max(1 - c, 0.02), y) for c, y in near if c > 1e-15]
        out[d] = sum(w * y for w, y in near) / sum(w for w, _ in near) if near else None
    return out


def test_votes_are_those_of_brute_force(spark, small):
    labels = [(i, int(i % 4 == 0)) for i in range(0, 150)]
    docs = spark.createDataFrame(small, "doc_id long, text string").repartition(3)
    model = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    want = brute(small, labels)
    got = {r.doc_id: r for r in toxicity.rate(docs, model).collect()}
    for d, v in want.items():
        score = model.blank if v is None else 1 / (1 + math.exp(-(model.slope * math.log(min(max(v, 0.01), 0.99) / (1 - min(max(v, 0.01), 0.99))) + model.shift)))
        assert got[d].score == pytest.approx(score, abs=1e-6), d
    assert all(got[i].predicted == int(i % 4 == 0) for i in range(200)) and got[200].score == got[201].score == got[202].score == model.blank < 0.5


def test_held_out_labels_change_nothing(spark, tmp_path):
    from pyspark.sql import functions as F

    from larkspur.llm.textkit import fold

    sf, rows = "/root/testdata/sf0.001", []
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for k, flip in enumerate((False, True)):
        here = str(tmp_path / f"d{k}")
        toxic = F.when((fold() == 0) & F.lit(flip), 1 - F.col("toxic")).otherwise(F.col("toxic")).cast("int")
        labels.withColumn("toxic", toxic).write.parquet(f"{here}/labels.parquet")
        spark.read.parquet(f"{sf}/documents.parquet").withColumns({"lang": F.lit("x" if flip else "y"), "source": F.lit(str(k))}).write.parquet(f"{here}/documents.parquet")
        rows.append({(r.doc_id, r.held_out, r.score, r.predicted) for r in registry.QUERIES["op5_toxicity"](spark, here).collect()})
    assert rows[0] == rows[1]


def test_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in registry.QUERIES["op5_toxicity"](spark, sf).collect() if r.held_out and r.doc_id in toxic]
    assert np.mean([r.predicted == toxic[r.doc_id] for r in rows]) > 0.97
