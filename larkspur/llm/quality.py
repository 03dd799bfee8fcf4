"""Host-level quality rules.

Each document is measured and held against fixed rules; failures are summed by host, the hosts' rates are shrunk with a
beta prior fitted to all hosts, and a host whose shrunk rate is too high takes its other documents with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import WORD_BYTE, U, Chunk, as_bytes, cut, mix, owners, positional, shingles, spans, table

WINDOW = 5
#: The characters counted as symbols.
SYMBOLS = b"#*$%&|<>"
SYMBOL_BYTE = np.zeros(256, bool)
SYMBOL_BYTE[list(SYMBOLS)] = True
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MAX_HOST_RATE = 0.5
#: Rejected hosts that are broadcast at most (their names); beyond it a host's rows are joined in so many parts.
BROADCAST_HOSTS, SALTS = 100_000, 64


def _measure(texts: list[bytes]) -> list[np.ndarray]:
    c = Chunk(texts)
    buf, n = c.buf, len(texts)
    ws, we, bounds = c.words()
    n_words = np.diff(bounds)

    def per_doc(flags: np.ndarray) -> np.ndarray:
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[c.ends] - total[c.starts]

    word = WORD_BYTE[buf]
    chars = per_doc(word & ((buf & 0xC0) != 0x80))
    symbols = per_doc(SYMBOL_BYTE[buf])

    ends = np.flatnonzero(buf == 10)
    starts = np.append(0, ends[:-1] + 1)
    first = np.searchsorted(ws, starts)
    full = (first < len(ws)) & (np.append(ws, len(buf))[first] < ends)
    starts, ends = starts[full], ends[full]
    doc = np.searchsorted(c.starts, starts, "right") - 1
    key = mix(c.hash(starts, ends) + mix(doc.astype(U) + U(1)))
    again = np.ones(len(key), bool)
    again[np.unique(key, return_index=True)[1]] = False
    dup = np.bincount(doc[again], minlength=n)

    runs = shingles(c.hash(ws, we), WINDOW)
    of = owners(bounds)
    at = np.flatnonzero(of[: len(runs)] == of[WINDOW - 1 :]) if len(runs) else np.zeros(0, np.int64)
    key = mix(runs[at] + mix(of[at].astype(U) + U(1)))
    _, where, counts = np.unique(key, return_inverse=True, return_counts=True)
    twice = at[counts[where] > 1] if len(at) else at
    edge = np.zeros(len(ws) + WINDOW + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + WINDOW, -1)
    inside = np.cumsum(edge)[: len(ws)] > 0
    repeat = np.bincount(of[inside], minlength=n)
    return [n_words, chars, symbols, dup, repeat]


def measure(docs: DataFrame, text: str = "text", whole: bool = False) -> DataFrame:
    """docs with the measures beside its own columns; null or empty texts measure zero everywhere.

    The text is left out unless `whole`. Columns of docs named like a measure are replaced.
    """
    keep = [f for f in docs.schema.fields if f.name != text and f.name not in MEASURES]
    fields = [*keep, *(docs.schema[text] for _ in range(whole))]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *(f"{m} long" for m in MEASURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = as_bytes(b.column(b.num_columns - 1))
            parts = [_measure(texts[i:j]) for i, j in spans(texts)]
            if parts:
                cols = [pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*parts, strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns[: len(fields)], *cols], names=[*(f.name for f in fields), *MEASURES])

    return docs.select(*(F.col(f"`{f.name}`") for f in keep), F.col(text)).mapInArrow(run, schema)


def base_failed():
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def any_failed():
    """Failures that count against the host: the base rules, many symbols, many repeated lines."""
    return F.col("base_failed") | (10 * F.col("n_symbols") > F.col("word_chars")) | (5 * F.col("n_dup_lines") > F.col("n_words"))


def host_rates(measured: DataFrame, host: str) -> DataFrame:
    """(host, host_docs, host_rate): failure rates shrunk to the mean by an empirical beta prior.

    The prior's mean is the overall rate and its weight follows from the variance of the hosts' rates, weighted by
    documents (at least 1, at most a million documents' worth). Null is a host of its own.
    """
    hosts = cut(measured.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("failed").cast("long")).alias("f")))
    whole = hosts.agg((F.sum("f") / F.sum("n")).alias("mu"), (F.sum(F.col("f") * F.col("f") / F.col("n")) / F.sum("n")).alias("second"))
    spread = F.col("second") - F.col("mu") * F.col("mu")
    weight = F.least(F.lit(1e6), F.greatest(F.lit(1.0), F.when(spread > 1e-12, F.col("mu") * (1 - F.col("mu")) / spread - 1).otherwise(1e6)))
    return hosts.crossJoin(F.broadcast(whole.select("mu", weight.alias("w")))).select("host", F.col("n").alias("host_docs"), ((F.col("f") + F.col("mu") * F.col("w")) / (F.col("n") + F.col("w"))).alias("host_rate"))


def judge(docs: DataFrame, host: str = "source", max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """docs without text, with the measures, base_failed, host_rate and kept.

    Empty table: empty result. Null text: measured as empty, so base_failed. Repeated rows are judged alike. Columns of
    docs named like a measure are replaced. Hosts are summed before anything moves, so a hot host costs one row a task.
    """
    docs = docs.drop("base_failed", "failed", "host", "host_rate", "host_docs", "kept", *MEASURES)
    measured = cut(measure(docs).withColumn("base_failed", base_failed()).withColumn("failed", any_failed()))
    rates = host_rates(measured, host)
    return (
        measured.join(rates, measured[host].eqNullSafe(rates["host"]), "left")
        .withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("host_rate"), F.lit(0.0)) <= max_host_rate))
        .drop("host", "failed")
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return judge(docs).select("doc_id", *MEASURES, "base_failed", "kept")


OP10_SQL = r"""
with d as (select doc_id, source, coalesce(text, '') as t from documents),
w as (select doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws from d),
g as (select doc_id, unnest(range(1, len(ws) - 3)) as i, ws from w where len(ws) >= 5),
g5 as (select doc_id, i, list_aggregate(ws[i:i+4], 'string_agg', ' ') as s from g),
gt as (select doc_id, i, count(*) over (partition by doc_id, s) as c from g5),
rp as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + 5)) as p from gt where c > 1) group by 1),
ln as (select doc_id, unnest(string_split(t, chr(10))) as l from d),
dl as (select doc_id, count(*) - count(distinct l) as n from ln where regexp_matches(l, '[^\x20\x09-\x0D]') group by 1),
m as (select w.doc_id, w.source, len(ws)::bigint as n_words,
        coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
        coalesce(dl.n, 0)::bigint as n_dup_lines, coalesce(rp.n, 0)::bigint as n_repeat_words
      from w left join dl on w.doc_id = dl.doc_id left join rp on w.doc_id = rp.doc_id),
b as (select *, (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed from m),
f as (select *, (base_failed or 10 * n_symbols > word_chars or 5 * n_dup_lines > n_words) as failed from b),
h as (select source, count(*)::double as n, sum(failed::int)::double as f from f group by 1),
p as (select sum(f) / sum(n) as mu, sum(f * f / n) / sum(n) as second from h),
q as (select mu, least(1e6, greatest(1.0, case when second - mu * mu > 1e-12 then mu * (1 - mu) / (second - mu * mu) - 1 else 1e6 end)) as w from p),
r as (select source, (f + mu * w) / (n + w) as rate from h, q)
select f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (not base_failed and rate <= 0.5) as kept
from f join r on f.source is not distinct from r.source
"""


def kept(docs: DataFrame, host: str = "source", text: str = "text", max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The rows of docs that judge() keeps, in docs' own columns, whatever their names.

    Null or empty texts and repeated rows are judged as judge() does. Rates are counted on measures alone; rejected hosts
    are broadcast up to BROADCAST_HOSTS of them, and texts don't move. Beyond that number the rows are joined with them
    by host and one of SALTS parts, so that a hot host is spread. Empty table: empty result.
    """
    plain, (host_, text_) = positional(docs, host, text)
    bare = measure(plain.select(F.col(host_).alias("host_"), F.col(text_).alias("text")))
    rates = host_rates(bare.withColumn("base_failed", base_failed()).withColumn("failed", any_failed()), "host_")
    bad = cut(rates.where(F.col("host_rate") > max_host_rate).select("host"))
    passed = measure(plain, text_, whole=True).where(~base_failed())
    if bad.count() <= BROADCAST_HOSTS:
        left = passed.join(F.broadcast(bad), passed[host_].eqNullSafe(bad["host"]), "left_anti")
    else:
        salt = F.pmod(F.xxhash64(text_), F.lit(SALTS)).cast("int")
        bad = bad.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        left = passed.withColumn("part_", salt).join(bad, passed[host_].eqNullSafe(bad["host"]) & (F.col("part_") == F.col("salt_")), "left_anti")
    return left.select(*plain.columns).toDF(*docs.columns)
