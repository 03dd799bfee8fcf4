"""Links of op3_ngram_join where equal texts come without id, or one id with several texts."""

import random

from larkspur.llm import ngram_join


def words(seed, n=80):
    rng = random.Random(seed)
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def near(w):
    return " ".join([*w[:-1], "other"])


def components(spark, rows):
    got = ngram_join.linked(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    return {(r.doc_id, r.component_id) for r in got}


def test_a_copy_without_id_hides_nothing(spark):
    w = words(1)
    assert components(spark, [(None, " ".join(w)), (7, " ".join(w)), (5, near(w))]) == {(None, None), (7, 5), (5, 5)}


def test_an_id_with_two_texts_keeps_the_links_of_both(spark):
    v, w = words(2), words(3)
    rows = [(1, " ".join(v)), (5, " ".join(v)), (5, " ".join(w)), (9, near(w)), (8, "something else")]
    assert components(spark, rows) == {(1, 1), (5, 1), (9, 1), (8, 8)}


def test_an_id_with_two_texts_of_which_both_are_copies(spark):
    v, w, x = words(4), words(5), words(6)
    rows = [(1, " ".join(v)), (2, " ".join(w)), (5, " ".join(v)), (5, " ".join(w)), (5, " ".join(x)), (9, near(x)), (10, near(v)), (11, near(w))]
    assert components(spark, rows) == {(i, 1) for i in (1, 2, 5, 9, 10, 11)}


def brute(rows):
    """Components by id, over all pairs of rows."""
    sets = [(d, {tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)}) for d, t in rows if d is not None]
    up = {d: d for d, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if 100 * len(x & y) >= 90 * len(x | y):
                p, q = sorted((find(a), find(b)))
                up[q] = p
    return {(d, None if d is None else find(d)) for d, _ in rows}


def test_against_brute_force(spark):
    rng, texts, rows = random.Random(8), [], []
    for _ in range(150):
        if texts and rng.random() < 0.7:
            t = rng.choice(texts).split()
            for _ in range(rng.randint(0, 2)):
                t[rng.randrange(len(t))] = f"n{rng.random()}"
            texts.append(" ".join(t))
        else:
            texts.append(" ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.choice([60, 90, 150]))))
        rows.append((rng.choice([None, rng.randrange(110), 200 + len(rows)]), texts[-1]))
    assert components(spark, rows) == brute(rows)
