"""Reshaping of frames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.plans.frame import Frame, quoted
from larkspur.session import shared_folder


def sort(columns: list[str], frame: Frame, ascending: bool = True) -> Frame:
    """Stable: equal rows stay as they were; nulls first going up, last going down."""
    frame = frame.ordered()
    keys = [quoted(c).asc_nulls_first() if ascending else quoted(c).desc_nulls_last() for c in columns]
    data = frame.data.orderBy(*keys, *map(quoted, frame.order))
    ranked = data.withColumn("__row2", F.monotonically_increasing_id()).drop(*(c for c in frame.order if c.startswith("__")))
    return Frame(ranked.withColumnRenamed("__row2", "__row"), ["__row"])


def stack(top: Frame, bottom: Frame) -> Frame:
    """Rows of both, same columns in the same order and of the same types."""
    if top.columns != bottom.columns or top.df.dtypes != bottom.df.dtypes:
        raise ValueError("frames of unlike columns can't be stacked")
    if not top.order and not bottom.order:
        return Frame(top.df.union(bottom.df))
    both = [top.ordered(), bottom.ordered()]
    kinds = [[f.data.schema[o].dataType for o in f.order] for f in both]
    if kinds[0] != kinds[1]:  # rows ordered by unlike columns are numbered
        both = [Frame(indexed(f, "__n"), ["__n"]) for f in both]
    order = [f"__o{k}" for k in range(len(both[0].order))]
    parts = [f.data.select(*map(quoted, f.columns), F.lit(i).alias("__part"), *(quoted(o).alias(n) for o, n in zip(f.order, order, strict=True))) for i, f in enumerate(both)]
    return Frame(parts[0].union(parts[1]), ["__part", *order])


def indexed(frame: Frame, name: str = "__i"):
    """The frame's rows numbered from 0 in order, without sending them all to one task.

    The rows are range-sorted and written once, with their partition and place in it, to the checkpoint folder: sorting
    again could draw other bounds. The partitions' sizes, a row for each, become offsets that are joined back.
    """
    frame = frame.ordered()
    spark = frame.data.sparkSession
    shared_folder(spark)
    held = frame.data.orderBy(*map(quoted, frame.order)).withColumns({"__p": F.spark_partition_id(), "__m": F.monotonically_increasing_id()}).checkpoint()
    sizes, before, total = sorted(map(tuple, held.groupBy("__p").count().collect())), [], 0
    for p, n in sizes:
        before.append((p, total))
        total += n
    offsets = F.broadcast(spark.createDataFrame(before, "__p int, __before long"))
    return held.join(offsets, "__p", "left").withColumn(name, F.col("__before") + F.col("__m") % (1 << 33)).drop("__p", "__m", "__before")


def side_by_side(left: Frame, right: Frame) -> Frame:
    """Columns of both by position; frames of unlike length are filled with nulls."""
    a = indexed(left).select(*map(quoted, left.columns), "__i")
    b = indexed(right).select(*map(quoted, right.columns), "__i")
    if clash := set(left.columns) & set(right.columns):
        raise ValueError(f"both frames have {sorted(clash)}")
    return Frame(a.join(b, "__i", "full").withColumnRenamed("__i", "__row"), ["__row"])


def reorder(columns: list[str], frame: Frame) -> Frame:
    rest = [c for c in frame.data.columns if c not in columns]
    return Frame(frame.data.select(*map(quoted, columns + rest)), frame.order)


def rename(columns: list[str], frame: Frame) -> Frame:
    """The first columns get these names; or, from a dict, the named ones."""
    names = columns if isinstance(columns, dict) else dict(zip(frame.columns, columns, strict=False))
    order = [names.get(c, c) for c in frame.order]
    return Frame(frame.data.withColumnsRenamed(names), order)


def unpivot(frame: Frame, index: list[str], on: list[str] | None = None) -> Frame:
    on = on or [c for c in frame.columns if c not in index]
    return Frame(frame.df.unpivot(list(index), list(on), "variable", "value"))


_PIVOT = {"first": F.first, "last": F.last, "max": F.max, "min": F.min, "mean": F.avg, "median": F.median, "sum": F.sum, "count": F.count}


def pivot(frame: Frame, index: list[str], on: str, values: str, how: str = "") -> Frame:
    """One column for each value of `on`, in the order values are first seen; "" asks for single values."""
    if how and how not in _PIVOT:
        raise ValueError(f"no pivot aggregate {how!r}")
    frame = frame.ordered()
    place = F.struct(*map(quoted, frame.order))
    seen = [r[0] for r in frame.data.groupBy(quoted(on)).agg(F.min(place).alias("o")).orderBy("o").select(quoted(on)).collect()]
    v = quoted(values)
    if how in ("first", "last"):
        agg = (F.min_by if how == "first" else F.max_by)(F.struct(v.alias("v")), place)["v"]
    elif how:
        agg = _PIVOT[how](v)
    else:
        agg = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("pivot found several values for one cell"))).otherwise(F.first(v))
    cells = frame.data.groupBy(*map(quoted, index), quoted(on).alias("__on")).agg(agg.alias("__v"), F.min(place).alias("__o"))
    wide = cells.groupBy(*map(quoted, index)).pivot("__on", [x for x in seen if x is not None]).agg(F.first("__v"))
    order = frame.data.groupBy(*map(quoted, index)).agg(F.min(place).alias("__row"))
    match = reduce(lambda a, b: a & b, (wide[c].eqNullSafe(order[c]) for c in index))
    joined = wide.join(order, match)
    return Frame(joined.select(*(wide[c] for c in wide.columns), "__row"), ["__row"])


def explode(frame: Frame, columns: list[str]) -> Frame:
    """A row for each element, the columns side by side; empty and null lists give one row of null."""
    zipped = F.arrays_zip(*map(quoted, columns))
    data = frame.data.withColumn("__z", F.explode_outer(F.when(F.size(zipped) > 0, zipped)))
    return Frame(data.select(*((F.col("__z")[c] if c in columns else quoted(c)).alias(c) for c in frame.data.columns)), frame.order)


def unique(frame: Frame) -> Frame:
    """Distinct rows, each where it first stood."""
    frame = frame.ordered()
    place = F.struct(*map(quoted, frame.order))
    return Frame(frame.data.groupBy(*map(quoted, frame.columns)).agg(F.min(place).alias("__row")), ["__row"])


QUANTILES = {"10%": 0.1, "25%": 0.25, "50%": 0.5, "75%": 0.75, "90%": 0.9}


def describe(frame: Frame) -> Frame:
    """count, null_count, mean, std, min, quantiles and max of the numeric and temporal columns, a row for each figure."""
    fields = [f for f in frame.df.schema.fields if isinstance(f.dataType, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType))]
    figures = ["count", "null_count", "mean", "std", "min", *QUANTILES, "max"]
    aggs = []
    for f in fields:
        c = quoted(f.name)
        x = c.cast("double") if isinstance(f.dataType, T.NumericType) else F.unix_micros(c.cast("timestamp")).cast("double")
        values = [F.count(c).cast("double"), F.count_if(c.isNull()).cast("double"), F.avg(x), F.stddev_samp(x), F.min(x), *(F.percentile(x, q) for q in QUANTILES.values()), F.max(x)]
        show = (lambda v: v.cast("string")) if isinstance(f.dataType, T.NumericType) else (lambda v: F.timestamp_micros(v.cast("long")).cast("string"))
        aggs.append(F.array(*(show(v) if i >= 2 and n != "std" else v.cast("string") for i, (n, v) in enumerate(zip(figures, values, strict=True)))).alias(f.name))
    wide = frame.df.agg(*aggs).withColumn("statistic", F.array(*map(F.lit, figures)))
    rows = wide.select(F.posexplode(F.arrays_zip("statistic", *(quoted(f.name) for f in fields))).alias("__row", "z"))
    numeric = {f.name for f in fields if isinstance(f.dataType, T.NumericType)}
    return Frame(rows.select("__row", F.col("z")["statistic"].alias("statistic"), *((F.col("z")[f.name].cast("double") if f.name in numeric else F.col("z")[f.name]).alias(f.name) for f in fields)), ["__row"])


def transpose(frame: Frame) -> Frame:
    """Rows become columns; for frames of few rows."""
    return Frame(indexed(frame).select(F.concat(F.lit("column_"), F.col("__i").cast("string")).alias("__name"), *map(quoted, frame.columns)).transpose("__name").withColumnRenamed("key", "column"))
