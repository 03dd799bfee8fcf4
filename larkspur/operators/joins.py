"""Joins of frames. On a match the right side's columns win, even with nulls; rows keep the left side's order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.plans.frame import Frame, quoted


class JoinProblem(ValueError):
    """A join's condition on its inputs doesn't hold."""


def _check_unique(right: DataFrame, on: list[str]) -> None:
    twice = right.where(" and ".join(f"`{c}` is not null" for c in on)).groupBy(*map(quoted, on)).count().where("count > 1").limit(1).collect()
    if twice:
        raise JoinProblem(f"right side has several rows for {dict(zip(on, twice[0], strict=False))}")


def _merged(left: Frame, right: Frame, on: list[str], how: str) -> Frame:
    shared = [c for c in right.columns if c in left.columns and c not in on]
    side = right.df.select(*(quoted(c).alias(f"__r_{c}" if c in shared else c) for c in right.columns), F.lit(True).alias("__hit"))
    data = left.data.join(side, on, how)
    values = [quoted(c) if c not in shared else F.when(F.col("__hit"), quoted(f"__r_{c}")).otherwise(quoted(c)).alias(c) for c in [*left.columns, *(c for c in right.columns if c not in left.columns)]]
    hidden = [quoted(c) for c in left.order if c.startswith("__")]
    return Frame(data.select(*values, *hidden), left.order)


def left_join(on: list[str], left: Frame, right: Frame, validate: bool = True) -> Frame:
    if validate:
        _check_unique(right.df, on)
    return _merged(left, right, on, "left")


def inner_join(on: list[str], left: Frame, right: Frame, validate: bool = True) -> Frame:
    if validate:
        _check_unique(right.df, on)
    return _merged(left, right, on, "inner")


def full_join(on: list[str], left: Frame, right: Frame, validate: bool = True) -> Frame:
    """Keys of both sides in one column."""
    if validate:
        _check_unique(right.df, on)
    return _merged(left, right, on, "full")


def cross_join(on: list[str], left: Frame, right: Frame) -> Frame:
    """Every pair; the keys have no say; right columns that exist on the left get the suffix _right."""
    side = right.df.toDF(*(f"{c}_right" if c in left.columns else c for c in right.columns))
    return Frame(left.data.crossJoin(side), left.order)


def semi_join(on: list[str], left: Frame, right: Frame) -> Frame:
    return Frame(left.data.join(right.df.select(*map(quoted, on)), on, "left_semi"), left.order)


def anti_join(on: list[str], left: Frame, right: Frame) -> Frame:
    return Frame(left.data.join(right.df.select(*map(quoted, on)), on, "left_anti"), left.order)


def asof_join(on: list[str], left: Frame, right: Frame) -> Frame:
    """The latest right row at or before each left row: the last key is the time, the others are equal.

    Both sides go through one shuffle by the equal keys; in time order the last right row seen is the match (of several
    at one time the last in the right side's order). A null time finds nothing.
    """
    *by, time = on
    left, right = left.ordered(), right.ordered()
    extra = [c for c in right.columns if c not in on]
    payload = F.struct(*(quoted(c).alias(c) for c in extra), F.lit(True).alias("__hit"))
    own = left.data.select(*map(quoted, on), F.struct(*map(quoted, left.data.columns)).alias("__left"), F.lit(None).alias("__right"), F.lit(1).alias("__side"), F.lit(None).alias("__seq"))
    seq = F.struct(*map(quoted, right.order)) if len(right.order) > 1 else quoted(right.order[0])
    other = right.data.where(quoted(time).isNotNull()).select(*map(quoted, on), F.lit(None).alias("__left"), payload.alias("__right"), F.lit(0).alias("__side"), seq.alias("__seq"))
    window = Window.partitionBy(*map(quoted, by)).orderBy(quoted(time).asc_nulls_first(), "__side", "__seq").rowsBetween(Window.unboundedPreceding, 0)
    seen = own.unionByName(other).withColumn("__found", F.last("__right", True).over(window)).where("__side = 1")
    found = F.when(quoted(time).isNotNull(), F.col("__found"))
    hit = F.coalesce(found["__hit"], F.lit(False))
    values = [F.when(hit, found[c]).otherwise(F.col("__left")[c]).alias(c) if c in extra else F.col("__left")[c].alias(c) for c in left.data.columns]
    return Frame(seen.select(*values, *(found[c].alias(c) for c in extra if c not in left.columns)), left.order)


def window_join(by: list[str], time: str, start: Column, end: Column, aggregates: list[Column], left: Frame, right: Frame) -> Frame:
    """Aggregates of the right rows with equal keys and a time in [start, end) of each left row; none: nulls (counts 0).

    Windows fall into classes by length, each up to twice as long as the last; times are cut into slices as long as the
    class allows, so that a window meets two or three slices of its key, however long others are, and the join is an
    equi-join with a residual. A right row is there once for each class in use (some two or three, 63 at most).
    """
    left = left.ordered()
    micros = lambda c: F.unix_micros(c.cast("timestamp")) if c is not None else c
    kind = right.data.schema[time].dataType.typeName()
    scale = micros if kind in ("timestamp", "timestamp_ntz", "date") else (lambda c: c)
    rows = left.data.withColumn("__start", start).withColumn("__end", end).withColumn("__id", F.monotonically_increasing_id() if len(left.order) > 1 else quoted(left.order[0]))
    size = (scale(F.col("__end")) - scale(F.col("__start"))).cast("double")
    rows = rows.withColumn("__class", F.when(size > 1, F.ceil(F.log2(size))).otherwise(0).cast("int"))
    classes = sorted(r[0] for r in rows.where("__end > __start").select("__class").distinct().collect())
    slot = lambda c, k: F.floor(scale(c) / F.pow(F.lit(2.0), k)).cast("long")
    wide = rows.where("__end > __start").select("__id", "__start", "__end", "__class", *(quoted(c).alias(f"__k_{c}") for c in by), F.explode(F.sequence(slot(F.col("__start"), F.col("__class")), slot(F.col("__end"), F.col("__class")))).alias("__slot"))
    side = right.df.withColumn("__class_r", F.explode(F.array(*map(F.lit, classes)).cast("array<int>"))).withColumn("__slot_r", slot(quoted(time), F.col("__class_r")))
    match = (F.col("__class") == F.col("__class_r")) & (F.col("__slot") == F.col("__slot_r")) & (quoted(time) >= F.col("__start")) & (quoted(time) < F.col("__end"))
    for c in by:
        match = match & (F.col(f"__k_{c}") == quoted(c))
    found = wide.join(side, match).groupBy("__id").agg(*aggregates)
    names = [c for c in found.columns if c != "__id"]
    data = rows.join(found.toDF("__id", *(f"__w_{c}" for c in names)), "__id", "left")
    counts = {f.name for f in found.schema.fields if not f.nullable}
    keep = [quoted(c) for c in left.data.columns if c not in names]
    return Frame(data.select(*keep, *((F.coalesce(quoted(f"__w_{c}"), F.lit(0)) if c in counts else quoted(f"__w_{c}")).alias(c) for c in names)), left.order)
