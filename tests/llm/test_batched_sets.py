"""Shingle sets and signatures are computed for many texts at once, and each text's are its own."""

import random

import numpy as np
import pyarrow as pa

from larkspur.llm import ngram_join, textkit


def texts(n, seed):
    rng = random.Random(seed)
    return [" ".join(rng.choice(["the", "Of", f"w{rng.randrange(300)}"]) for _ in range(rng.choice([0, 1, 4, 5, 6, 40, 300]))) for _ in range(n)]


def test_texts_side_by_side_have_the_sets_they_have_alone():
    many = [t.encode() for t in [*texts(300, 1), "x" * 200_000, " \n", "a b c d e f " * 20_000]]
    for width in (1, 3, 5):
        together = ngram_join.sets_of(many, width)
        for t, s in zip(many, together, strict=True):
            w = t.lower().split()
            assert len(s) == (len({tuple(w[i : i + width]) for i in range(len(w) - width + 1)}) if len(w) >= width else bool(w))
            assert (s[1:] > s[:-1]).all()
            assert (s == ngram_join.sets_of([t], width)[0]).all()


def test_sets_side_by_side_have_the_signatures_they_have_alone():
    sets = [s for s in ngram_join.sets_of([t.encode() for t in texts(400, 2)], 3) if len(s)]
    for percent in (80, 90):
        lows = ngram_join.size_classes(percent, 2 * max(map(len, sets)) + 4)
        sig, owner = ngram_join.signatures(sets, percent, lows)
        for i, s in enumerate(sets):
            assert sorted(sig[owner == i].tolist()) == sorted(ngram_join.part_signatures(s, percent, lows).tolist())


def test_a_profile_mixes_each_shingle_few_times_and_in_few_calls(monkeypatch):
    some = [" ".join(f"v{random.Random(k).random()}{i}" for i in range(60)) for k in range(500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(500), pa.int64()), pa.array(some)], ["doc_id", "text"])
    seen, real = [], textkit.mix
    for module in (textkit, ngram_join):
        monkeypatch.setattr(module, "mix", lambda x: seen.append(np.size(x)) or real(x))
    assert len(list(ngram_join._profile(5, 80, 8)(iter([batch])))) >= 9
    assert len(seen) < 500 and sum(seen) < 6 * 500 * 60, (len(seen), sum(seen))
