"""Column expressions that know how they are to be evaluated: by row, over a window, or one for each group."""

from __future__ import annotations

import datetime as dt
import itertools
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_names = itertools.count()


def literal(value: Any) -> Column:
    """A constant column; lists become arrays, times microseconds of day."""
    if isinstance(value, Column):
        return value
    if isinstance(value, (list, tuple)):
        return F.array(*map(literal, value))
    if isinstance(value, str):
        return F.lit(str(value))
    if isinstance(value, dt.datetime) and value.tzinfo is None:
        return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(value)


@dataclass
class Expr:
    """build(context) gives the column; agg: one value for each group; win: by row it takes a window; virtual: the row index."""

    build: Callable[[Context], Column]
    name: str | None = None
    agg: bool = False
    win: bool = False
    virtual: bool = False

    def alias(self, name: str) -> Expr:
        return Expr(self.build, name, self.agg, self.win, self.virtual)


class Context:
    """The frame under evaluation. Expressions may stage columns on it: windows can't nest, nor stand inside aggregates."""

    def __init__(self, df: DataFrame, order: list[str], keys: list[Column] | None = None, group: bool = False):
        self.holder, self.order_names, self.keys, self.group, self.total = [df], order, keys or [], group, False

    @property
    def df(self) -> DataFrame:
        return self.holder[0]

    def by_row(self) -> Context:
        """The same frame, evaluated by row."""
        other = Context(self.df, self.order_names, self.keys)
        other.holder = self.holder
        return other

    def order(self) -> list[Column]:
        """The row order; frames without one get it here."""
        if not self.order_names:
            self.holder[0] = self.df.withColumn("__row", F.monotonically_increasing_id())
            self.order_names.append("__row")
        return [F.col(f"`{c}`") for c in self.order_names]

    def position(self) -> Column:
        """One comparable value for the row order; in a spread aggregate nulls come first, as in windows."""
        cols = self.order()
        return cols[0] if len(cols) == 1 and not self.total else F.struct(*cols)

    def whole(self):
        return Window.partitionBy(*self.keys)

    def ordered(self, *by: Column):
        return Window.partitionBy(*self.keys).orderBy(*by, *self.order())

    def running(self):
        return self.ordered().rowsBetween(Window.unboundedPreceding, 0)

    def last_rows(self, n: int):
        return self.ordered().rowsBetween(-(int(n) - 1), 0)

    def spread(self, build: Callable[[Context], Column]) -> Column:
        """An aggregate of the whole frame as a value of each row: one row, broadcast, as a window without keys is one task.
        No scalar subquery: scans would skip row groups by its value, and their bounds leave out NaN."""
        other, name = self.by_row(), f"__x{next(_names)}"
        other.group = other.total = True
        column = build(other)
        self.holder[0] = self.df.crossJoin(F.broadcast(self.df.agg(column.alias(name))))
        return F.col(name)

    def stage(self, column: Column) -> Column:
        name = f"__x{next(_names)}"
        self.holder[0] = self.df.withColumn(name, column)
        return F.col(name)

    def plain(self, value: Any) -> Column:
        """An argument as a column by row, without a window in it."""
        if not isinstance(value, Expr):
            return literal(value)
        column = value.build(self.by_row())
        return self.stage(column) if value.win or value.agg else column

    def kind(self, column: Column) -> T.DataType:
        return self.df.select(column.alias("c")).schema[0].dataType

    def scan(self, column: Column, fn) -> Column:
        """A new column from a function of Arrow batches: a column's values, group by group in row order, and marks of the
        groups' first rows. The function keeps a group's state from batch to batch; rows arrive as the row number's window
        leaves them, and nothing moves below a function that isn't deterministic."""
        given = self.stage(column)
        opens = self.stage(F.row_number().over(self.ordered()) == 1)
        return self.stage(F.arrow_udf(fn, "double").asNondeterministic()(given, opens))

    def take(self, column: Column, source: Callable[[Column, Column], Column]) -> Column:
        """The column's value at another position of the group: source(position, length), both from 0; by a join."""
        value = self.stage(column)
        keys = [self.stage(k) for k in self.keys]
        at = self.stage(F.row_number().over(self.ordered()) - 1)
        size = self.stage(F.count(F.lit(1)).over(self.whole()))
        want = self.stage(source(at, size))
        names = [f"__x{next(_names)}" for _ in range(len(keys) + 2)]
        side = self.df.select(*(c.alias(n) for c, n in zip([*keys, at, value], names, strict=True)))
        match = F.col(names[len(keys)]) == want
        for k, n in zip(keys, names, strict=False):
            match = match & k.eqNullSafe(F.col(n))
        self.holder[0] = self.df.join(side, match, "left")
        return F.col(names[-1])


def named(args: tuple) -> str | None:
    return next((a.name for a in args if isinstance(a, Expr) and a.name), None)


def _spread(build: Callable[[Context], Column], agg: bool = True) -> Callable[[Context], Column]:
    """An aggregate's build, by row over the whole frame if there are no keys."""
    return lambda c: c.spread(build) if agg and not c.group and not c.keys else build(c)


def by_row(fn: Callable[..., Column], *args: Any) -> Expr:
    """fn of the arguments' columns. If all of them are aggregates, so is the whole; if some are, they spread over rows."""
    exprs = [a for a in args if isinstance(a, Expr)]
    agg = bool(exprs) and all(a.agg for a in exprs)
    win = any(a.win for a in exprs) or any(a.agg for a in exprs) and not agg
    return Expr(_spread(lambda c: fn(*(a.build(c) if isinstance(a, Expr) else a for a in args)), agg), named(args), agg, win)


def typed_row(fn: Callable[..., Column], *args: Any) -> Expr:
    """As by_row, with the context as first argument of fn."""
    exprs = [a for a in args if isinstance(a, Expr)]
    agg = bool(exprs) and all(a.agg for a in exprs)
    win = any(a.win for a in exprs) or any(a.agg for a in exprs) and not agg
    return Expr(_spread(lambda c: fn(c, *(a.build(c) if isinstance(a, Expr) else a for a in args)), agg), named(args), agg, win)


def aggregate(fn: Callable[..., Column], *args: Any, spread: Callable[..., Column] | None = None) -> Expr:
    """fn of the arguments, once for a group; by row over the whole partition (or by spread, where fn can't be a window)."""

    def build(c: Context) -> Column:
        cols = [c.plain(a) for a in args]
        return fn(*cols) if c.group else (spread or fn)(*cols).over(c.whole())

    return Expr(_spread(build), named(args), agg=True)


def ordered_aggregate(fn: Callable[[Context, Column], Column], spread: Callable[[Context, Column], Column], arg: Any) -> Expr:
    """An aggregate that depends on the row order."""
    return Expr(_spread(lambda c: fn(c, c.plain(arg)) if c.group else spread(c, c.plain(arg))), named((arg,)), agg=True)


def windowed(fn: Callable[..., Column], *args: Any) -> Expr:
    """fn of the context and the arguments' columns, a value for each row that looks at others."""
    return Expr(lambda c: fn(c.by_row(), *(c.plain(a) if isinstance(a, Expr) else a for a in args)), named(args), win=True)
