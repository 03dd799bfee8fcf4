"""URL filtering: fixed host-and-path rules, then association rules mined from labelled URLs.

FP-growth mines combinations of URL tokens that go with the label `block`; rules are pruned by support, confidence and
by simpler rules that say as much, and match through an inverted index from their rarest token.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import table

#: Fixed values: (verdict, host, path) of the rules that come before any mined one.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
MIN_SUPPORT, MIN_COUNT, MIN_CONFIDENCE, MAX_RULES = 0.002, 30, 0.5, 10_000
BLOCK = "label=block"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z in lower case, and the path; both empty without `://`."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^(?:(?!://).)*://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fixed_rule(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fixed rule that fits and its verdict, null if none does (equal lengths: the first by name)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), [-ord(c) for c in r[1] + r[2]])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def tokens(url: str | None) -> list[str]:
    """The distinct tokens of a URL: scheme, labels, segments with digits folded, parameter names."""
    scheme, mark, rest = (url or "").partition("://")
    if not mark:
        return []
    rest, _, fragment = rest.partition("#")
    rest, _, query = rest.partition("?")
    host, _, path = rest.partition("/")
    fold = lambda x: re.sub(r"\d+", "0", x.lower())
    labels = host.lower().split(".")
    out = ["scheme:" + scheme.lower(), *("host:" + x for x in labels), *("word:" + w for x in labels if "-" in x for w in x.split("-"))]
    out += ["path:" + fold(x) for x in path.split("/") if x]
    out += ["param:" + fold(x.partition("=")[0]) for x in query.split("&") if x]
    return list(dict.fromkeys(out + (["fragment"] if fragment else [])))


@dataclass(frozen=True)
class Rule:
    tokens: tuple[str, ...]
    confidence: float
    support: float


class RuleIndex:
    """Rules under their rarest token; a rule matches a URL that has all its tokens."""

    def __init__(self, rules: list[Rule]):
        often: dict[str, int] = {}
        for r in rules:
            for t in r.tokens:
                often[t] = often.get(t, 0) + 1
        self.lists: dict[str, list[Rule]] = {}
        for r in sorted(rules, key=lambda r: (-r.confidence, -r.support, r.tokens)):
            self.lists.setdefault(min(r.tokens, key=lambda t: (often[t], t)), []).append(r)

    def match(self, have: list[str]) -> Rule | None:
        """The most confident rule whose tokens are all there."""
        own = set(have)
        found = [next((r for r in self.lists[t] if own.issuperset(r.tokens)), None) for t in have if t in self.lists]
        return min((r for r in found if r), key=lambda r: (-r.confidence, -r.support, r.tokens), default=None)


def with_tokens(urls: DataFrame, url: str = "url") -> DataFrame:
    """urls with a `tokens` array; null or schemeless URLs have none."""
    urls = urls.drop("tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [tokens(x) for x in b.column(b.schema.get_field_index(url)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.list_(pa.string()))], [*b.schema.names, "tokens"])

    return urls.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in urls.schema.fields), "tokens array<string>"]))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_count: int = MIN_COUNT, min_confidence: float = MIN_CONFIDENCE, max_rules: int = MAX_RULES) -> list[Rule]:
    """Rules from labelled (url, block: boolean) rows: token combinations of at least that support, in MIN_COUNT
    URLs labelled block at least, whose URLs are labelled block at least that often. max_rules bounds what comes to the driver, the most confident first; a rule is
    pruned if one of its parts alone is as confident."""
    baskets = with_tokens(labelled.select("url", "block")).select(F.when(F.col("block"), F.concat("tokens", F.array(F.lit(BLOCK)))).otherwise(F.col("tokens")).alias("items")).where(F.size("items") > 0)
    if not (n := baskets.count()):
        return []
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(min_support, min_count / n)), minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.where(F.array_contains("consequent", BLOCK)).orderBy(F.desc("confidence"), F.desc("support"), F.size("antecedent"), F.array_join(F.array_sort("antecedent"), " ")).limit(max_rules)
    known: dict[tuple[str, ...], Rule] = {}
    for r in rules.collect():
        known[tuple(sorted(r["antecedent"]))] = Rule(tuple(sorted(r["antecedent"])), r["confidence"], r["support"])
    part = lambda r: any((p := known.get(tuple(t for t in r.tokens if t != x))) and p.confidence >= r.confidence for x in r.tokens)
    return [r for r in known.values() if len(r.tokens) == 1 or not part(r)]


def judge(urls: DataFrame, rules: list[Rule], url: str = "url", fixed: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """urls with host, path, rule, verdict, mined_rule and confidence.

    A fixed rule decides if one fits; else block if a mined rule matches, else allow. Null and odd URLs: empty host and
    path, no rule, allow. Columns of urls named like a result are replaced. Empty table: empty result.
    """
    urls = urls.drop("host", "path", "rule", "verdict", "mined_rule", "confidence")
    held = urls.sparkSession.sparkContext.broadcast(RuleIndex(rules))  # at most MAX_RULES rules

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [held.value.match(tokens(x)) for x in b.column(b.schema.get_field_index(url)).to_pylist()]
            names, sure = [" & ".join(r.tokens) if r else None for r in found], [r.confidence if r else None for r in found]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(sure, pa.float64())], [*b.schema.names, "mined_rule", "confidence"])

    mined = urls.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in urls.schema.fields), "mined_rule string, confidence double"]))
    host, path = host_and_path(F.col(url))
    with_parts = mined.withColumn("host", host).withColumn("path", path)
    rule, verdict = fixed_rule(F.col("host"), F.col("path"), fixed)
    return with_parts.withColumn("rule", rule).withColumn("verdict", F.coalesce(verdict, F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow")))


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is labelled block where labels has quality 0 or toxic 1 under its id."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("block"))
    rules = mine(pages.join(labels, "page_id").where("block is not null"))
    return judge(pages, rules).select("page_id", "host", "path", "rule", "verdict", "mined_rule", "confidence")
