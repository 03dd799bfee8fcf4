"""The pipeline's near-duplicate stage against brute force at five words and 0.8."""

import random
import re

import numpy as np

import corpus_pipeline
from larkspur.llm import ngram_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def five_words(t):
    w = WORD.findall(t.lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def kept(docs):
    """Ids that are the smallest of their component."""
    sets, up = {d: five_words(t) for d, t in docs}, {d: d for d, _ in docs}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if b < a and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {d for d in sets if find(d) == d}


def test_stage_is_what_brute_force_says(spark):
    rng, docs = random.Random(4), []
    for _ in range(60):
        w = [f"w{rng.randrange(500)}" for _ in range(rng.choice([4, 30, 49, 50, 58, 120, 400]))]
        docs.append((len(docs), " ".join(w)))
        for _ in range(rng.randint(0, 3)):
            c = list(w)
            for _ in range(rng.randint(1, 1 + len(w) // 40)):
                c[rng.randrange(len(c))] = f"n{rng.random()}"
            docs.append((len(docs), " ".join(c)))
    base = [f"v{i}" for i in range(54)]
    one = [*base[:27], "other", *base[28:]]
    docs += [(len(docs), " ".join(base)), (len(docs) + 1, " ".join(one))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()}
    assert got == kept(docs) and len(docs) - 1 not in got


def family(rng, size, words=60):
    """Near copies of one text, with up to nine words of their own."""
    base, out = [f"b{i}" for i in range(words)], []
    for _ in range(size):
        c = list(base)
        for _ in range(rng.randint(0, 9)):
            c[rng.randrange(words)] = f"x{rng.random()}"
        out.append(" ".join(c[: rng.randint(words - 15, words)]))
    return out


def test_blocks_of_many_sets_are_searched_by_tiles(spark, monkeypatch):
    docs = list(enumerate(family(random.Random(9), 90)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    for sets in (7, 40, 1024):
        monkeypatch.setattr(ngram_join, "TILE_SETS", sets)
        assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()} == kept(docs), sets


def test_search_finds_all_links_at_any_similarity():
    rng = random.Random(3)
    sets = ngram_join.sets_of([t.encode() for t in family(rng, 80)], 3)
    index = ngram_join.Index(sets)
    for percent in (50, 80, 90, 100):
        for q, a in enumerate(sets):
            got = sorted(ngram_join.divide_skip(index, a, percent, lambda x, q=q: x == q))
            assert got == [p for p, b in enumerate(sets) if p != q and 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b))], (percent, q)


def test_signatures_meet_at_lower_similarity():
    rng = np.random.default_rng(7)
    lows, random_pairs = ngram_join.size_classes(80, 5000), 0
    for _ in range(300):
        a = np.unique(rng.integers(0, 1 << 62, rng.integers(1, 1500)).astype(np.uint64))
        cut = rng.integers(0, len(a) // 9 + 1)
        b = np.unique(np.concatenate([a[cut:], rng.integers(0, 1 << 62, cut).astype(np.uint64)]))
        sa, sb = (ngram_join.part_signatures(x, 80, lows) for x in (a, b))
        if 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)):
            assert np.intersect1d(sa, sb).size
        c = rng.integers(0, 1 << 62, len(a)).astype(np.uint64)
        random_pairs += np.intersect1d(sa, ngram_join.part_signatures(np.unique(c), 80, lows)).size > 0
    assert random_pairs < 30
