"""Each pipeline stage on odd rows and on columns named like the operators' own, and the stages' deletions by scope."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from larkspur.llm import langid, quality, textkit

CLASH = ("host", "n_words", "kept_text", "gid", "score", "lang_pred", "ambiguous", "n_removed", "bucket", "blob", "component_id", "c0_", "cluster", "size", "r", "failed")


@pytest.fixture(scope="module")
def odd(spark):
    words = [" ".join(f"{w}{k}" for k in range(30)) for w in ("alpha", "beta", "gamma")]
    rows = [(1, words[0], "en", "a"), (2, words[0], "en", "a"), (3, words[1] + " more", "en", None), (4, None, "en", "b"), (5, "", None, "b"), (6, " \n\t", "de", "b"), (None, words[2], None, None), (8, words[1] + " else", "en", None), (3, words[1] + " more", "en", None), (9, " ".join([words[0], *(f"tail{k}" for k in range(20000))]), "en", "c")]
    df = spark.createDataFrame([(d, t, l, s, len(t or "")) for d, t, l, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in CLASH})


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_with_clashing_columns(spark, odd, name):
    got = dict(corpus_pipeline.STAGES)[name](spark, odd, "")
    rows = got.collect()
    ids = {r.doc_id for r in rows}
    if name == "packing":
        assert len([r for r in rows if r.piece == 0]) == 10
        return
    assert got.columns == odd.columns
    assert all(r[c] == c + ("-" if r.doc_id is None else str(r.doc_id)) for r in rows for c in CLASH)
    want = {"quality": {1, 2, 3, None, 8, 9}, "near_duplicates": {1, 3, 4, 5, 6, None, 9}, "repeated_strings": {1, 3, 6, None, 8, 9}}
    if name in want:
        assert ids == want[name]
    else:
        assert not ids & {4, 5, 6} and {r.lang for r in rows} <= {"en", "de"}
    if name == "repeated_strings":
        assert all(r.n_chars == len(r.text) for r in rows) and {r.text for r in rows if r.doc_id == 8} == {"else"}
    none = dict(corpus_pipeline.STAGES)[name](spark, odd.limit(0), "")
    assert none.count() == 0


def test_languages_are_those_of_the_operator(spark, odd):
    model = langid.learn(odd.select("doc_id", "text", "lang"))
    seen = {(r.doc_id, r.lang_pred) for r in langid.identify(odd.select("doc_id", "text"), model).collect() if r.lang_pred != "und" and not (r.ambiguous and r.score < corpus_pipeline.LEAST_SCORE)}
    assert seen == {(r.doc_id, r.lang) for r in corpus_pipeline.language(spark, odd, "").collect()}


def test_many_bad_hosts_are_joined(spark, monkeypatch):
    good = " ".join(f"w{k}" for k in range(20))
    df = spark.createDataFrame([(i, good if i % 5 == 0 else "short", f"h{i % 7}" if i < 70 else "ok") for i in range(70)] + [(i, good + str(i), "ok") for i in range(70, 120)], "doc_id long, text string, source string")
    want = {r.doc_id for r in quality.kept(df).collect()}
    monkeypatch.setattr(quality, "BROADCAST_HOSTS", 0)
    assert {r.doc_id for r in quality.kept(df).collect()} == want == {r.doc_id for r in quality.judge(df).where("kept").collect()}


def test_what_is_cut_can_go(spark):
    held = textkit.cut(spark.range(10).groupBy((F.col("id") % 3).alias("k")).count())
    where = held.stored_at.removeprefix("file:")
    assert held.count() == 3 and os.path.isdir(where)
    textkit.discard(held)
    assert not os.path.exists(where) and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_run_is_its_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = textkit.cut(stage(spark, docs, sf))
    want = {(r.doc_id, r.piece, r["size"]) for r in corpus_pipeline.packed(spark, docs, sf).collect()}
    assert {(r.doc_id, r.piece, r["size"]) for r in corpus_pipeline.run(spark, sf).collect()} == want
