"""From raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import langid, ngram_join, packing, quality, suffix_dedup
from larkspur.llm.textkit import cut, discard, ensure_checkpoint_dir, lean, positional, store

#: An ambiguous prediction less sure than this is rejected.
LEAST_SCORE = 0.6
#: Near duplicates share that many percent of their shingles of so many words.
NEAR_WIDTH, NEAR_PERCENT = 5, 80
#: Ids that are broadcast at most, some 16 bytes each.
BROADCAST_IDS = 2_000_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go, and those whose two nearest languages can't be told apart; lang becomes the
    predicted one.

    Null texts and texts without letters have no language. Nothing to learn from: nothing has a language. Repeated rows
    are judged alike. Columns may have any names. Empty table: empty result.
    """
    lean(spark)
    plain, (text, lang) = positional(docs, "text", "lang")
    seen = langid.identify(plain, langid.learn(docs.select("doc_id", "text", "lang")), text)
    seen = seen.where((F.col("lang_pred") != langid.UNKNOWN) & ~(F.col("ambiguous") & (F.col("score") < LEAST_SCORE)))
    return seen.withColumn(lang, F.col("lang_pred")).select(*plain.columns).toDF(*docs.columns)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the quality rules go, and those of hosts that fail them too often.

    Null and empty texts fail. Null sources are one host. Repeated rows are judged alike. Columns may have any names.
    Empty table: empty result.
    """
    lean(spark)
    return quality.kept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays.

    Texts without words and rows without id link with nothing and stay. Rows with one id are one document: all stay or
    all go. Columns may have any names. Empty table: empty result. The ids that go are broadcast up to BROADCAST_IDS of
    them, and texts don't move; beyond that number rows are joined with them by id.
    """
    lean(spark)
    plain, (doc_id,) = positional(docs, "doc_id")
    gone = cut(ngram_join.linked(docs, width=NEAR_WIDTH, percent=NEAR_PERCENT).where("component_id < doc_id").select("doc_id").distinct())
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return plain.join(gone, plain[doc_id] == gone["doc_id"], "left_anti").toDF(*docs.columns)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings that an earlier document has too are cut out of the texts; documents with nothing left go.

    Null and empty texts go. Rows with one id don't count against each other; rows without id come after all others.
    n_chars, where there is one, becomes the new text's length. Columns may have any names. Empty table: empty result.
    """
    lean(spark)
    plain, (doc_id, text) = positional(docs, "doc_id", "text")
    left = suffix_dedup.dedup(plain, doc_id=doc_id, text=text).where("kept_text <> ''")
    own = {doc_id: F.col("doc_id"), text: F.col("kept_text")}
    if "n_chars" in docs.columns:
        own[plain.columns[docs.columns.index("n_chars")]] = F.length("kept_text").cast("long")
    return left.select(*(own.get(c, F.col(c)).alias(c) for c in plain.columns)).toDF(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document lies in which training sequence.

    Null and empty texts are pieces of no words. Rows with one id are packed singly, never into one bin. Other columns
    play no part. Empty table: empty result.
    """
    lean(spark)
    return packing.pack(packing.sized(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("quality", rules),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("packing", packed),
]
#: SQL can't express the learnt first stage nor the bins of the last; the tests hold both against brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared checkpoint folder and read by the next, then
    deleted. The last one's input stays until the session ends."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, store(stage(spark, docs, sf_dir), f"{folder}/{name}")
        if i:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
