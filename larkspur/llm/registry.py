"""The operators' queries and their SQL, for the driver contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, fingerprints, langid, ngram_join, packing, pitman_yor, quality, suffix_dedup, toxicity, url_rules

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": fingerprints.op1_fingerprints,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_ngram_join": ngram_join.op3_ngram_join,
    "op4_packing": packing.op4_packing,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_bpe": bpe.op6_bpe,
    "op7_langid": langid.op7_langid,
    "op8_url_rules": url_rules.op8_url_rules,
    "op9_pitman_yor": pitman_yor.op9_pitman_yor,
    "op10_quality": quality.op10_quality,
}
ORACLE_SQL: dict[str, str] = {
    "op2_suffix_dedup": suffix_dedup.OP2_SQL,
    "op3_ngram_join": ngram_join.OP3_SQL,
    "op10_quality": quality.OP10_SQL,
}
