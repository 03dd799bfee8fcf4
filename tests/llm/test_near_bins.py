"""Clusters of op4_packing: near copies, and copies that differ by white space at their ends."""

import random

from larkspur.llm import packing


def test_near_copies_are_one_cluster(spark):
    rng = random.Random(6)
    w = [f"w{rng.randrange(10**6)}" for _ in range(80)]
    base, one = " ".join(w), " ".join([*w[:40], "other", *w[41:]])
    far = " ".join(f"w{rng.randrange(10**6)}" for _ in range(80))
    rows = [(1, base), (2, one), (3, base.upper() + "\n"), (4, "\t " + base), (5, far), (6, "one two"), (7, "\tONE  two\n"), (8, None), (9, " \n"), (None, base), (None, far), (None, "no id")]
    docs = spark.createDataFrame([(d, t, str(k)) for k, (d, t) in enumerate(rows)], "doc_id long, text string, source string").repartition(3)
    got = {int(r.source): r.cluster for r in packing.sized(docs).collect()}
    assert len(got) == len(rows)
    sizes = {int(r.source): r.size for r in packing.sized(docs).collect()}
    assert sizes == {k: len((t or "").split()) for k, (_, t) in enumerate(rows)}
    groups = [{0, 1, 2, 3}, {4}, {5, 6}, {7, 8}, {11}]
    for g in groups:
        assert len({got[k] for k in g}) == 1, g
    assert len({got[min(g)] for g in groups}) == len(groups)
    bins = {}
    for r in packing.pack(packing.sized(docs)).collect():
        bins.setdefault(r.bin_id, []).append(r.doc_id)
    assert not any(len({1, 2, 3, 4} & set(b)) > 1 for b in bins.values())
