"""Frames: DataFrames with a row order."""

from __future__ import annotations

import datetime as dt
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Frame:
    """A DataFrame and the columns that order its rows. Columns named __… are hidden; without order columns rows have
    no order until something asks for one."""

    def __init__(self, df: DataFrame, order: list[str] | None = None):
        self.data, self.order = df, list(order or [])

    @property
    def columns(self) -> list[str]:
        return [c for c in self.data.columns if not c.startswith("__")]

    @property
    def df(self) -> DataFrame:
        """The visible columns."""
        return self.data.select(*map(quoted, self.columns))

    def ordered(self) -> Frame:
        """This frame with an order, its rows' present one if it had none."""
        return self if self.order else Frame(self.data.withColumn("__row", F.monotonically_increasing_id()), ["__row"])

    def tidy(self) -> Frame:
        """Without hidden columns that the order doesn't need."""
        keep = [*self.columns, *(c for c in self.order if c.startswith("__"))]
        return Frame(self.data.select(*map(quoted, dict.fromkeys(keep))), self.order)

    def sorted(self) -> DataFrame:
        """The visible columns, rows in order."""
        return (self.data.orderBy(*map(quoted, self.order)) if self.order else self.data).select(*map(quoted, self.columns))

    def collect(self) -> list[dict]:
        return [r.asDict() for r in self.sorted().collect()]


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def from_columns(spark: SparkSession, columns: dict[str, Any]) -> Frame:
    """A small frame from literal columns; single values repeat."""
    size = max((len(v) for v in columns.values() if isinstance(v, list)), default=1)
    whole = {k: v if isinstance(v, list) else [v] * size for k, v in columns.items()}
    if any(len(v) != size for v in whole.values()):
        raise ValueError("columns of unequal length")
    rows = [(i, *(_plain(v[i]) for v in whole.values())) for i in range(size)]
    schema = "__row long, " + ", ".join(f"`{k}` {sql_type(v)}" for k, v in whole.items())
    return Frame(spark.createDataFrame(rows, schema), ["__row"])


def _plain(v: Any) -> Any:
    if isinstance(v, list):
        return [_plain(x) for x in v]
    return str(v) if isinstance(v, str) else v


def sql_type(values: list) -> str:
    v = next((x for x in values if x is not None), None)
    if any(isinstance(x, float) for x in values):
        return "double"
    if isinstance(v, list):
        return f"array<{sql_type([y for x in values if x is not None for y in x])}>"
    for kind, name in ((bool, "boolean"), (int, "long"), (float, "double"), (dt.datetime, "timestamp_ntz"), (dt.date, "date"), (dt.timedelta, "interval day to second"), (dt.time, "time(6)"), (dict, "map<string,string>")):
        if isinstance(v, kind):
            return name
    return "string"
