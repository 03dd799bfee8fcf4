"""Large blocks of the near-duplicate search: unlike texts leave them, and parts meet in rounds."""

import random
from itertools import combinations

import corpus_pipeline
from larkspur.llm import ngram_join
from test_near_stage import family, kept

LINE = [f"common{i}" for i in range(14)]


def test_unlike_texts_with_a_common_line_are_not_searched(spark, monkeypatch):
    rng, texts = random.Random(6), family(random.Random(2), 12)
    texts += [" ".join([*LINE, *(f"u{rng.random()}" for _ in range(rng.randint(16, 40)))]) for _ in range(150)]
    docs, seen, real = list(enumerate(texts)), [], ngram_join.cut

    def cut(df):
        out = real(df)
        if set(out.columns) == {"doc_id", "n", "block", "band", "tiles"}:
            seen.extend(r.doc_id for r in out.collect())
        return out

    monkeypatch.setattr(ngram_join, "cut", cut)
    monkeypatch.setattr(ngram_join, "TILE_SETS", 16)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()}
    assert got == kept(docs) and len(got) < len(docs)
    assert len([d for d in seen if d >= 12]) < 15


def test_parts_meet_once_in_rounds_of_few_copies(spark):
    for tiles in (2, 3, 8, 9):
        held = spark.range(tiles).selectExpr("id as doc_id", "0 as block", "0 as band", "'' as blob", f"{tiles} as tiles", "int(id) as chunk")
        for wide in (1, 10, 100):
            met = []
            for low, high in ngram_join.rounds(tiles, wide, 80):
                rows = ngram_join.in_tiles(held, low, high).collect()
                assert len(rows) * wide <= max(80 // 2, 2 * wide) * tiles
                met += {(r.i, r.j) for r in rows}
                assert all({r.doc_id for r in rows if (r.i, r.j) == t} == set(t) for t in {(r.i, r.j) for r in rows})
            assert sorted(met) == list(combinations(range(tiles), 2)), (tiles, wide)
