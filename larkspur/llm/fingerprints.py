"""Bottom-k sketches of word shingles, all in DataFrame functions.

A sketch is the sorted array of the k smallest 48-bit hashes of a text's distinct shingles. Sketches merge across parts
by union, and estimate resemblance, containment and the number of distinct shingles. Up to k shingles they are exact.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .textkit import group_counts, table

K, WIDTH = 256, 5
SPACE = float(1 << 48)
LOWEST = -(1 << 63)


def words(text: Column) -> Column:
    """The text's words, runs of anything but white space; null or blank: none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t\n\x0B\f\r]+"))


def sketch(words: Column, width: int = WIDTH, k: int = K) -> Column:
    """The sketch of an array of words (a column, not an expression: it is read for each shingle); none: empty."""
    at = F.sequence(F.lit(0), F.size(words) - width)
    many = F.transform(at, lambda i: F.shiftrightunsigned(F.xxhash64(*(F.get(words, i + j) for j in range(width))), 16))
    one = F.array(F.shiftrightunsigned(F.xxhash64(F.concat_ws(" ", words)), 16))
    none = F.array().cast("array<bigint>")
    return F.when(F.size(words) >= width, F.slice(F.array_sort(F.array_distinct(many)), 1, k)).when(F.size(words) > 0, one).otherwise(none)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts taken together."""
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity, 0 to 1; two empty sketches are alike."""
    both = merge(a, b, k)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.size(F.array_intersect(F.array_intersect(a, b), both)) / F.size(both))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; the exact number below k."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * SPACE / F.get(a, F.lit(k - 1)))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too, 0 to 1; an empty a is contained."""
    share = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k) / distinct_shingles(a, k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), share))


def merge_by(sketches: DataFrame, key: str, fingerprint: str = "sketch", k: int = K) -> DataFrame:
    """(key, sketch): one merged sketch for each key. Each task passes on a key's k least hashes only (as often as
    it has them), so hot keys hold."""
    hashes = sketches.select(key, F.explode_outer(fingerprint).alias("h"))
    least = hashes.withColumn("r", F.dense_rank().over(Window.partitionBy(key).orderBy(F.asc_nulls_last("h")))).where(F.col("r") <= k)
    return least.select(key, "h").distinct().groupBy(key).agg(F.array_sort(F.collect_list("h")).alias("sketch"))


def as_text(a: Column) -> Column:
    """A sketch as a string: base64 of its hashes, six bytes each."""
    return F.base64(F.unhex(F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 12, "0")), "")))


def followed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, bucket, halo, ord) in id ranges, each with the first row of the range below it as its halo.

    Range bounds are quantiles of the ids; only the bounds and each range's largest id come to the driver, as many as
    there are ranges. Each text moves once (the first of a range twice).
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    docs = docs.withColumn("ord", F.coalesce("doc_id", F.lit(LOWEST)))
    _, n = group_counts(docs, text)
    bounds = sorted(set(map(int, docs.approxQuantile("ord", [i / n for i in range(1, n)], 0.2 / n))))
    bounds = [LOWEST, *(x for x in bounds if x > LOWEST)]
    step = math.isqrt(len(bounds)) + 1
    whole, coarse = (F.array(*map(F.lit, x)).cast("array<bigint>") for x in (bounds, bounds[::step]))
    docs = docs.withColumn("part", F.size(F.filter(coarse, lambda b: b <= F.col("ord"))) - 1)
    fine = F.slice(whole, F.col("part") * step + 1, F.lit(step))
    docs = docs.withColumn("bucket", F.col("part") * step + F.size(F.filter(fine, lambda b: b <= F.col("ord")))).drop("part")
    tops = sorted(map(tuple, docs.groupBy("bucket").agg(F.max("ord")).collect()))
    above = [(tops[i][1], tops[(i + 1) % len(tops)][0]) for i in range(len(tops))]
    pairs = F.array(*(F.struct(F.lit(x).cast("bigint").alias("ord"), F.lit(y).alias("above")) for x, y in above)).cast("array<struct<ord:bigint,above:int>>")
    halos = F.broadcast(spark.range(1).select(F.inline(pairs)))
    placed = docs.join(halos, "ord", "left").withColumn("to", F.explode(F.array_compact(F.array(F.lit(0), F.when(F.col("above").isNotNull(), F.lit(1))))))
    return placed.select("doc_id", "text", F.when(F.col("to") == 1, F.col("above")).otherwise(F.col("bucket")).alias("bucket"), F.col("to").alias("halo"), "ord")


def fingerprints(docs: DataFrame, width: int = WIDTH, k: int = K) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_distinct).

    The edited text has the last half of the characters replaced by as many from the start of the next document, by
    falling id. Null text: as empty. Null id: after all others. Rows with one id follow one another by text; the last
    document is followed by the first, an only one by itself. Empty table: empty result.
    """
    order = Window.partitionBy("bucket").orderBy("halo", F.desc("ord"), "text")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    d = followed(docs).withColumn("next_text", F.lead("text").over(order)).withColumn("n_chars", F.length("text").cast("long"))
    d = d.withColumn("edited", F.concat(F.col("text").substr(F.lit(1), F.col("n_chars").cast("int") - half), F.col("next_text").substr(F.lit(1), half)))
    d = d.select("doc_id", "bucket", "halo", "ord", "text", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), words(F.col("text")).alias("w"), words(F.col("edited")).alias("v"))
    d = d.select("doc_id", "bucket", "halo", "ord", "text", "n_chars", "edited_sha256", sketch(F.col("w"), width, k).alias("a"), sketch(F.col("v"), width, k).alias("b"))
    d = d.withColumn("c", F.lead("a").over(order)).where("halo = 0")
    near = [resemblance(F.col("a"), F.col(x), k).cast("double").alias(n) for x, n in (("b", "near_edited"), ("c", "near_next"))]
    return d.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("a")).alias("fingerprint"), as_text(F.col("b")).alias("edited_fingerprint"), *near, distinct_shingles(F.col("a"), k).alias("n_distinct"))


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
