"""Readers and writers of single files and folders."""

from __future__ import annotations

import datetime as dt
import json
import zlib
from typing import Any

from pyspark.sql import SparkSession

from larkspur.functions.columns import TYPES
from larkspur.plans.frame import Frame, quoted

from .partitioned import _fs, size_of


def _schema(types: dict[str, str]) -> str:
    return ", ".join(f"`{k}` {TYPES[v]}" for k, v in types.items())


def read_csv(spark: SparkSession, path: str, header: bool = True, separator: str = ",", ignore_errors: bool = False, types: dict | None = None) -> Frame:
    """types select and type columns; without them Spark infers."""
    reader = spark.read.option("header", header).option("sep", separator).option("mode", "PERMISSIVE" if ignore_errors else "FAILFAST")
    if not types:
        return Frame(reader.option("inferSchema", True).csv(path))
    names = reader.csv(path).columns
    return Frame(reader.schema(_schema({n: types.get(n, "str") for n in names})).csv(path).select(*map(quoted, types)))


def read_json(spark: SparkSession, path: str, types: dict | None = None) -> Frame:
    """An array of records, or a record a line."""
    reader = spark.read.schema(_schema(types)) if types else spark.read
    first = spark.read.text(path).where("trim(value) <> ''").limit(1).collect()
    return Frame(reader.option("multiLine", bool(first and first[0][0].lstrip().startswith("["))).json(path))


def read_parquet(spark: SparkSession, path: str, n: int | None = None, rechunk: bool = False, columns: list[str] | None = None) -> Frame:
    df = spark.read.parquet(path)
    df = df.select(*map(quoted, columns)) if columns else df
    return Frame(df.limit(n) if n else df)


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def write_csv(path: str, frame: Frame, separator: str = ",") -> int:
    if len(separator) != 1 or ord(separator) > 127:
        raise ValueError("a separator is one ASCII character")
    frame.sorted().write.mode("overwrite").csv(path, sep=separator, header=True)
    return size_of(frame.data.sparkSession, path)


def write_json(path: str, frame: Frame) -> int:
    frame.sorted().write.mode("overwrite").json(path)
    return size_of(frame.data.sparkSession, path)


def write_parquet(path: str, frame: Frame, level: int = 3) -> int:
    if not 1 <= level <= 22:
        raise ValueError("a compression level lies between 1 and 22")
    frame.sorted().write.mode("overwrite").option("compression", "zstd").parquet(path)
    return size_of(frame.data.sparkSession, path)


def write_bytes(spark: SparkSession, path: str, data: bytes, append: bool = False) -> int:
    fs, p, _ = _fs(spark, path)
    if append and fs.exists(p):
        stream = fs.open(p)
        data = bytes(stream.readAllBytes()) + data
        stream.close()
    out = fs.create(p, True)
    out.write(bytearray(data))
    out.close()
    return len(data)


def read_bytes(spark: SparkSession, path: str) -> bytes:
    fs, p, _ = _fs(spark, path)
    stream = fs.open(p)
    data = bytes(stream.readAllBytes())
    stream.close()
    return data


def exists(spark: SparkSession, path: str) -> bool:
    fs, p, _ = _fs(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> bool:
    """Deletes one file; folders stay."""
    fs, p, _ = _fs(spark, path)
    if fs.exists(p) and fs.getFileStatus(p).isDirectory():
        raise IsADirectoryError(path)
    return fs.delete(p, False)


_TAGS = {"date": (dt.date, dt.date.fromisoformat), "datetime": (dt.datetime, dt.datetime.fromisoformat), "time": (dt.time, dt.time.fromisoformat)}


def _pack(v: Any) -> Any:
    if isinstance(v, Frame):
        import pyarrow as pa

        sink = pa.BufferOutputStream()
        t = v.sorted().toArrow()
        with pa.ipc.new_stream(sink, t.schema) as w:
            w.write_table(t)
        return {"#": "frame", "v": sink.getvalue().to_pybytes().hex()}
    if isinstance(v, dt.timedelta):
        return {"#": "span", "v": v // dt.timedelta(microseconds=1)}
    for tag in ("datetime", "date", "time"):
        if isinstance(v, _TAGS[tag][0]):
            return {"#": tag, "v": v.isoformat()}
    if isinstance(v, dict):
        return {"#": "dict", "v": [[k, _pack(x)] for k, x in v.items()]}
    return [_pack(x) for x in v] if isinstance(v, list) else v


def _unpack(v: Any, spark: SparkSession) -> Any:
    if isinstance(v, list):
        return [_unpack(x, spark) for x in v]
    if not isinstance(v, dict):
        return v
    tag, x = v["#"], v["v"]
    if tag == "frame":
        import pyarrow as pa

        return Frame(spark.createDataFrame(pa.ipc.open_stream(bytes.fromhex(x)).read_all()))
    if tag == "span":
        return dt.timedelta(microseconds=x)
    return {k: _unpack(y, spark) for k, y in x} if tag == "dict" else _TAGS[tag][1](x)


def write_object(spark: SparkSession, path: str, value: Any) -> int:
    """Any value, compressed; for values of the driver's size."""
    return write_bytes(spark, path, zlib.compress(json.dumps(_pack(value)).encode()))


def read_object(spark: SparkSession, path: str) -> Any:
    return _unpack(json.loads(zlib.decompress(read_bytes(spark, path))), spark)
