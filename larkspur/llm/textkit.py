"""Vectorised text primitives shared by the operators: words, rolling hashes, document chunks.

A chunk is a run of whole documents laid out in one byte buffer, each followed by a newline, so that one NumPy call
serves hundreds of documents. Substring hashes come from one prefix sum per chunk: with an odd multiplier every power
has an inverse modulo 2**64, so the hash of bytes [s, e) is (P[e] - P[s]) * M**-s and does not depend on position.
"""

from __future__ import annotations

import contextlib
import ctypes
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20
U = np.uint64
_MULTIPLIER, _INVERSE = 0x9E3779B97F4A7C15 | 1, pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def return_memory() -> None:
    """Makes this process give freed arrays back to the system: idle Python workers count in an executor's memory too."""
    pa.set_memory_pool(pa.system_memory_pool())
    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 19)  # arrays from half a MB on are mapped singly
        libc.mallopt(-1, 1 << 22)  # free memory kept at the heap's top
        libc.mallopt(-8, 1)  # one arena


return_memory()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


BYTE_VALUE = mix(np.arange(1, 257, dtype=U) * U(_MULTIPLIER))
#: The bytes that separate words (space, tab, line feed, vertical tab, form feed, carriage return).
SEPARATORS = b" \t\n\x0b\x0c\r"
WORD_BYTE = np.ones(256, bool)
WORD_BYTE[list(SEPARATORS)] = False
#: Letters, digits and every byte of a multi-byte character.
TERM_BYTE = np.array([chr(b).isalnum() and b < 128 or b >= 128 for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse, kept for the next call."""
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 4096)
        for k, base in enumerate((_MULTIPLIER, _INVERSE)):
            steps = np.full(size, base, U)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


class Chunk:
    """Whole documents in one buffer: buf, and the first byte and the end of each document."""

    def __init__(self, texts: list[bytes], lower: bool = False, word_byte: np.ndarray = WORD_BYTE):
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(lens + 1) - 1
        self.starts = self.ends - lens
        self.buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        if lower:
            self.buf = LOWER[self.buf]
        self._word_byte = word_byte
        self._prefix: np.ndarray | None = None

    def hash(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """64-bit hashes of the byte ranges [s, e)."""
        pw, inv = powers(len(self.buf) + 1)
        if self._prefix is None:
            self._prefix = np.zeros(len(self.buf) + 1, U)
            np.cumsum(BYTE_VALUE[self.buf] * pw[:-1], out=self._prefix[1:])
        return mix((self._prefix[e] - self._prefix[s]) * inv[s])

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and where each document's words begin in them (one entry more than documents)."""
        inside = np.zeros(len(self.buf) + 1, np.int8)
        inside[1:] = self._word_byte[self.buf]
        inside[-1] = 0
        step = np.diff(inside)
        ws, we = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        return ws, we, np.append(np.searchsorted(ws, self.starts), len(ws))

    def word_hashes(self) -> tuple[np.ndarray, np.ndarray]:
        ws, we, bounds = self.words()
        return self.hash(ws, we), bounds


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of that many words; element i starts at word i."""
    if len(words) < width:
        return np.zeros(0, U)
    n = len(words) - width + 1
    h = words[:n].copy()
    for k in range(1, width):
        h = mix(h) + words[k : k + n]
    return mix(h)


def owners(bounds: np.ndarray) -> np.ndarray:
    """The document of each item, from where each document's items begin."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def as_bytes(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null becomes empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def spans(texts: list[bytes], limit: int = CHUNK_BYTES, rows: int = 4096) -> Iterator[tuple[int, int]]:
    """Consecutive runs of documents of at most that many bytes (or one document)."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and (size + len(t) > limit or i - at >= rows):
            yield at, i
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


_PACK, _UNPACK = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value; bytes of equal weight lie together, so small numbers cost little."""
    head, body = [], []
    for a in arrays:
        a = np.ascontiguousarray(a)
        head.append(f"{a.dtype.str}:{len(a)}")
        body.append(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b"")
    return _PACK.compress(",".join(head).encode() + b"\0" + b"".join(body))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = _UNPACK.decompress(blob)
    cut = raw.index(b"\0")
    out, at = [], cut + 1
    for item in raw[:cut].decode().split(","):
        kind, n = item.split(":")
        dtype, n = np.dtype(kind), int(n)
        size = dtype.itemsize * n
        planes = np.frombuffer(raw, np.uint8, size, at).reshape(dtype.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(dtype).reshape(n) if n else np.zeros(0, dtype))
        at += size
    return out


def bucket_count(rows: int) -> int:
    """Hash buckets for so many rows: they grow with the square root."""
    return max(8, math.ceil(math.sqrt(rows) / 4))


def group_counts(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """How many groups of documents and how many hash buckets for these documents.

    Each group sends one packed value to each bucket. Buckets grow with the square root of the rows; a group holds about
    16,384 rows and 64 MB of text at most, so that both the values' number and a task's memory stay in hand from
    thousands to billions.
    """
    rows, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    root = bucket_count(rows)
    return max(root, math.ceil(rows / 16384), math.ceil(size / (1 << 26))), root


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster names the shared folder in spark.checkpoint.dir; one of our own serves only a local master without it."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or f"{spark.conf.get('spark.sql.warehouse.dir', 'file:/tmp/larkspur')}/_checkpoints")
    return context._jsc.sc().getCheckpointDir().get()


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the jobs run inside go when their query ends. Only for results that nothing reads again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def store(df: DataFrame, path: str) -> DataFrame:
    """df written as a table to that folder and read from it; the folder goes with the session at the latest."""
    spark = df.sparkSession
    with tidy(spark):
        df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    held = spark.read.schema(df.schema).parquet(path)
    held.stored_at = path
    return held


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage: written once to the shared checkpoint folder, read from there by all that follows."""
    return store(df, f"{ensure_checkpoint_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}")


def discard(*frames: DataFrame) -> None:
    """Deletes what cut() or store() wrote for these frames; nothing may read them any more."""
    for df in frames:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def positional(docs: DataFrame, *given: str | None) -> tuple[DataFrame, list[str | None]]:
    """docs with its columns named by position, so that no name of an operator's own can clash, and what the given
    names became (the first column of a name counts). Names come back with toDF(*docs.columns)."""
    own = [f"c{i}_" for i in range(len(docs.columns))]
    return docs.toDF(*own), [own[docs.columns.index(g)] if g is not None else None for g in given]


def fold(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 5; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def lean(spark: SparkSession, rows: int = 1000) -> None:
    """Small Arrow batches: whole texts are long, and a batch is held several times over in Python and in the JVM."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    lean(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
