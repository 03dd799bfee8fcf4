"""Tables partitioned by date or year, in Spark's own layout: root/table/date=2024-01-02/part-….parquet.

The catalogue also reads the flat layout of older stores, in which each partition is a file such as 2024.01.02_0000.
"""

from __future__ import annotations

import datetime as dt
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.plans.frame import Frame, quoted

CODECS = {"zstd", "snappy", "gzip", "lz4", "uncompressed"}


class PartitionProblem(ValueError):
    """A partition's condition, schema or name doesn't hold."""


@dataclass
class PartTable:
    """A table on disk: kind is date, year or single."""

    name: str
    path: str
    kind: str
    data: DataFrame

    @property
    def frame(self) -> Frame:
        return Frame(self.data)


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p, jvm


def children(spark: SparkSession, path: str) -> list[tuple[str, bool, int]]:
    """(name, is a folder, bytes) of what a folder holds, through Hadoop's file systems."""
    fs, p, _ = _fs(spark, path)
    return sorted((s.getPath().getName(), s.isDirectory(), s.getLen()) for s in fs.listStatus(p)) if fs.exists(p) else []


def size_of(spark: SparkSession, path: str) -> int:
    fs, p, _ = _fs(spark, path)
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


def write(spark: SparkSession, root: str, partition, table: str, frame: Frame, sort: list[str] | None = None, rechunk: bool = False, overwrite: bool = False, codec: str = "zstd") -> int:
    """Writes one partition (a date, a year, or None for a single table) and returns the bytes it now holds.

    Names and types must be those of the table. Appending adds files; overwrite replaces the partition; rechunk leaves
    it in one file, sorted again (one task writes it). What replaces a partition is written beside it and takes its place
    by renames, so the frame may read the partition itself, and a write that fails leaves the old rows.
    """
    if codec not in CODECS:
        raise PartitionProblem(f"no codec {codec!r}")
    path = f"{root}/{table}"
    key = None if partition is None else "year" if isinstance(partition, int) else "date"
    if key == "year" and not 1000 <= partition <= 3999:
        raise PartitionProblem("a year lies between 1000 and 3999")
    df = frame.df.drop(key) if key and key in frame.columns else frame.df
    have = children(spark, path)
    if have:
        known = spark.read.parquet(path).drop(*([key] if key else []))
        if [(f.name, f.dataType) for f in known.schema] != [(f.name, f.dataType) for f in df.schema]:
            raise PartitionProblem(f"{table} has the columns {known.dtypes}, not {df.dtypes}")
    target = f"{path}/{key}={partition.isoformat() if isinstance(partition, dt.date) else partition}" if key else path
    if rechunk and not overwrite and children(spark, target):
        df, overwrite = spark.read.schema(df.schema).parquet(target).union(df), True
    rows = df.coalesce(1) if rechunk else df
    if sort:
        rows = rows.sortWithinPartitions(*map(quoted, sort))
    if not overwrite:
        rows.write.mode("append").option("compression", codec).parquet(target)
        return size_of(spark, target)
    beside = f"{root}/_{table}-{uuid.uuid4().hex}"
    try:
        rows.write.option("compression", codec).parquet(f"{beside}/new")
        replace(spark, target, f"{beside}/new", f"{beside}/old")
    finally:
        fs, p, _ = _fs(spark, beside)
        fs.delete(p, True)
    return size_of(spark, target)


def replace(spark: SparkSession, target: str, new: str, old: str) -> None:
    """Puts the folder new where target is, which goes to old; if that fails, target comes back."""
    fs, to, jvm = _fs(spark, target)
    path = jvm.org.apache.hadoop.fs.Path
    fs.mkdirs(to.getParent())
    had = fs.exists(to)
    if had and not fs.rename(to, path(old)):
        raise PartitionProblem(f"{target} can't be moved")
    if not fs.rename(path(new), to):
        if had:
            fs.rename(path(old), to)
        raise PartitionProblem(f"{new} can't be moved to {target}")


def _flat(names: list[str]) -> str | None:
    if names and all(re.fullmatch(r"(\d{4}\.\d\d\.\d\d|\d{4})_\d{4}|schema", n) for n in names):
        return "date" if any(len(n) >= 13 for n in names) else "year"
    return None


def discover(spark: SparkSession, root: str, prefix: str = "") -> dict[str, PartTable]:
    """All tables below a folder; those in subfolders have dotted names."""
    out: dict[str, PartTable] = {}
    for name, folder, _ in children(spark, root):
        path, full = f"{root}/{name}", f"{prefix}{name}"
        if name.startswith(("_", ".")):
            continue
        if not folder:
            if name.endswith(".parquet"):
                out[full.removesuffix(".parquet")] = PartTable(full.removesuffix(".parquet"), path, "single", spark.read.parquet(path))
            continue
        inner = children(spark, path)
        names = [n for n, _, _ in inner if not n.startswith(("_", "."))]
        kind = next((k for k in ("date", "year") if any(n.startswith(f"{k}=") for n in names)), None)
        if kind:
            out[full] = PartTable(full, path, kind, spark.read.parquet(path))
        elif flat := _flat(names):
            files = [f"{path}/{n}" for n in names if n != "schema"]
            out[full] = PartTable(full, path, flat, spark.read.parquet(*(files or [f"{path}/schema"])))
        elif any(n.endswith(".parquet") for n in names):
            out[full] = PartTable(full, path, "single", spark.read.parquet(path))
        else:
            out |= discover(spark, path, f"{full}.")
    return out


def conditions_name(node: tuple, column: str) -> bool:
    """Whether a where clause bounds the partition column: the column on the left of = >= > <= < within in."""
    return node[0] == "binary" and node[1] in ("=", ">=", ">", "<=", "<", "within", "in") and node[2] == ("id", column)

