"""Language identification by error-correcting output codes over byte n-grams.

Every language gets a codeword; one binary classifier for each bit learns from hashed n-grams. A text's bit scores are
held against all codewords, each bit's loss weighted by how well its classifier did on the sample, and the codeword of
least loss wins. A winner hardly better than the next is flagged as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .textkit import Chunk, U, as_bytes, fold, mix, spans, table

#: Hashed features for each n-gram length.
FEATURES = 4096
GRAMS = (2, 3)
#: The learning sample: at most so many documents of each language, those whose ids hash lowest, and so many languages.
SAMPLE, MAX_LANGUAGES = 300, 64
UNKNOWN = "und"
AMBIGUOUS = 0.05
CHUNK_DOCS = 256


def features(texts: list[bytes]) -> np.ndarray:
    """Unit-length vectors of the square roots of hashed n-gram counts; n-grams never cross documents."""
    c = Chunk(texts, lower=True)
    n, size = len(texts), FEATURES * len(GRAMS)
    doc = np.repeat(np.arange(n), c.ends - c.starts + 1)
    room = np.repeat(c.ends, c.ends - c.starts + 1) - np.arange(len(c.buf))
    out = np.zeros((n, size), np.float32)
    wide = c.buf.astype(np.uint32)
    for k, g in enumerate(GRAMS):
        key = np.zeros(len(wide), np.uint32)
        for i in range(g):
            key[: len(wide) - i] |= wide[i:] << np.uint32(8 * i)
        at = np.flatnonzero(room >= g)
        slot = (key[at] * np.uint32(2654435761)) >> np.uint32(20)
        out[:, k * FEATURES : (k + 1) * FEATURES] = np.bincount(doc[at] * FEATURES + slot, minlength=n * FEATURES).reshape(n, FEATURES)
    np.sqrt(out, out=out)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def codewords(n: int) -> np.ndarray:
    """A row of -1 and 1 for each language: all splits of up to five languages, else random ones far apart."""
    if n <= 5:
        bits = np.arange(1, max(2, 1 << (n - 1)))
        return np.array([[1 if i == 0 else (1 if b >> (i - 1) & 1 else -1) for b in ((1 << (n - 1)) - 1 - bits)] for i in range(n)], np.float32)
    rng, best = np.random.default_rng(7), None
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], np.float32), (n, int(np.ceil(10 * np.log2(n)))))
        apart = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
        if best is None or apart > best[0]:
            best = apart, code
    return best[1]


class Model:
    """languages, their codewords, and for each bit a linear classifier and the weight of its loss."""

    def __init__(self, x: np.ndarray, lang: list[str], penalty: float = 0.3):
        self.languages = sorted(set(lang))
        self.code = codewords(len(self.languages))
        y = self.code[[self.languages.index(v) for v in lang]]
        counts = np.bincount([self.languages.index(v) for v in lang])
        weight = np.sqrt(1 / counts[[self.languages.index(v) for v in lang]])[:, None]
        weight /= weight.mean()
        xw = x * weight
        # ridge regression through the sample's Gram matrix; the diagonal gives leave-one-out predictions
        gram = xw @ xw.T + penalty * np.eye(len(x))
        inverse = np.linalg.inv(gram)
        a = inverse @ (y * weight)
        self.w = (xw.T @ a).astype(np.float32)
        left_out = y - (a / np.diag(inverse)[:, None]) / weight
        right = np.clip((np.sign(left_out) == y).mean(0), 0.01, 0.999)
        self.bit_weight = np.maximum(np.log(right / (1 - right)), 0.05)
        self.bit_weight /= self.bit_weight.sum()
        # sharpness of the scores: the one under which the left-out sample is likeliest
        loss, own = self.losses(left_out), np.array([self.languages.index(v) for v in lang])
        fits = []
        for t in (1, 2, 4, 8, 16, 32):
            z = -t * loss
            fits.append((float((z[np.arange(len(own)), own] - np.log(np.exp(z).sum(1))).mean()), t))
        self.sharpness = max(fits)[1]

    def losses(self, f: np.ndarray) -> np.ndarray:
        """Weighted hinge loss of each text (row) against each codeword."""
        return np.stack([(np.maximum(0, 1 - f * c) * self.bit_weight).sum(1) for c in self.code], 1)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest codeword, its probability, and whether the runner-up is about as near."""
        loss = self.losses(x @ self.w)
        z = np.exp(-self.sharpness * (loss - loss.min(1, keepdims=True)))
        best = loss.argmin(1)
        if len(self.languages) == 1:
            return best, np.ones(len(x)), np.zeros(len(x), bool)
        two = np.partition(loss, 1, axis=1)
        return best, 1 / z.sum(1), two[:, 1] - two[:, 0] < AMBIGUOUS


def learn(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fits a model on a bounded sample of docs (doc_id, text, lang): at most `sample` documents of each language and
    MAX_LANGUAGES languages, the most frequent ones. None if no row has a language and a text."""
    known = docs.where("lang is not null and text is not null and doc_id is not null")
    langs = [r[0] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()]
    if not langs:
        return None
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    ids = known.where(F.col("lang").isin(langs)).select("doc_id", "lang").withColumn("r", rank).where(F.col("r") <= sample).select("doc_id", "lang")
    # at most MAX_LANGUAGES * sample ids
    rows = known.join(F.broadcast(ids.distinct()), ["doc_id", "lang"]).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = as_bytes(b.column(1))
            for i, j in spans(texts, rows=CHUNK_DOCS):
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], pa.array([v.tobytes() for v in features(texts[i:j]).astype(np.float16)], pa.binary())], ["lang", "x"])

    found = sorted(map(tuple, rows.mapInArrow(run, "lang string, x binary").collect()))
    return Model(np.stack([np.frombuffer(x, np.float16) for _, x in found]).astype(np.float32), [v for v, _ in found]) if found else None


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs (text included) with lang_pred, score and ambiguous.

    Null texts, and texts without any letter, get `und` with score 1, as does everything if there is no model. Columns
    of docs named like a result are replaced. Texts are read whole.
    """
    docs = docs.drop("lang_pred", "score", "ambiguous")
    fields = docs.schema.fields
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "lang_pred string, score double, ambiguous boolean"])
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model | None = held.value
        for b in batches:
            texts, has = as_bytes(b.column(b.schema.get_field_index(text))), np.array(b.column(b.num_columns - 1).to_pylist(), bool)
            lang, score, flag = [UNKNOWN] * len(texts), np.ones(len(texts)), np.zeros(len(texts), bool)
            for i, j in spans(texts, rows=CHUNK_DOCS) if m else ():
                best, p, amb = m.predict(features(texts[i:j]))
                for k in np.flatnonzero(has[i:j]):
                    lang[i + k], score[i + k], flag[i + k] = m.languages[best[k]], p[k], amb[k]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(flag)], [*b.schema.names[:-1], "lang_pred", "score", "ambiguous"])

    letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("__letter")
    return docs.select(*(F.col(f"`{f.name}`") for f in fields), letter).mapInArrow(run, schema)


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (F.coalesce(fold(), F.lit(-1)) == 0).alias("held_out"))
    model = learn(docs.where(~F.col("held_out")))
    return identify(docs.select("doc_id", "held_out", "text"), model).drop("text")
