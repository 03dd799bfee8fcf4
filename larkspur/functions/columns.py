"""Column forms of the built-in functions, all on Spark's own functions but for exponential weights."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.plans.expr import Context, Expr, aggregate, by_row, literal, ordered_aggregate, typed_row, windowed

COLUMN: dict[str, Callable[..., Expr]] = {}


def column(*names: str):
    def keep(fn):
        for n in names:
            COLUMN[n] = fn
        return fn

    return keep


def col(x: Any) -> Column:
    return x if isinstance(x, Column) else literal(x)


def rows(**table: Callable[..., Column]) -> None:
    for name, fn in table.items():
        COLUMN[name] = lambda *a, fn=fn: by_row(lambda *c: fn(*map(col, c)), *a)


# predicates and logic; | and & are greatest and least, which skip nulls

COLUMN |= {
    op: (lambda a, b, fn=fn: by_row(lambda x, y: fn(col(x), col(y)), a, b))
    for op, fn in {
        "=": lambda a, b: a.eqNullSafe(b),
        "~": lambda a, b: a.eqNullSafe(b),
        "!=": lambda a, b: a != b,
        "<": lambda a, b: a < b,
        "<=": lambda a, b: a <= b,
        ">": lambda a, b: a > b,
        ">=": lambda a, b: a >= b,
        "|": F.greatest,
        "&": F.least,
        "||": lambda a, b: a | b,
        "&&": lambda a, b: a & b,
        "??": F.coalesce,
        "*": lambda a, b: a * b,
    }.items()
}
rows(when=lambda c, t, e: F.when(c, t).otherwise(e), null=F.isnull, lit=lambda x: x)
COLUMN["not"] = lambda a: typed_row(lambda c, x: ~col(x) if isinstance(c.kind(col(x)), T.BooleanType) else col(x) == 0, a)


@column("within")
def within(value, bounds):
    lo, hi = bounds
    return by_row(lambda x: col(x).between(literal(lo), literal(hi)), value)


@column("in")
def in_(value, values):
    if isinstance(values, Expr):
        return by_row(lambda x, y: F.array_contains(y, x), value, values)
    values = values if isinstance(values, list) else [values]
    known = [literal(v) for v in values if v is not None]

    def build(x):
        hit = F.coalesce(x.isin(*known), F.lit(False)) if known else F.lit(False)
        return hit | x.isNull() if None in values else hit

    return by_row(build, value)


@column("like")
def like(text, pattern):
    return by_row(lambda x: F.rlike(x, literal(pattern)), text)


@column("filter")
def filter_(flags):
    return by_row(lambda x: F.filter(F.transform(x, lambda v, i: F.when(v, i)), lambda v: v.isNotNull()), flags)


# arithmetic


def divide(a: Column, b: Column) -> Column:
    """True division; by zero infinity or NaN, never an error."""
    a, b = a.cast("double"), b.cast("double")
    zero = F.when(F.isnan(a) | (a == 0), float("nan")).when(a > 0, float("inf")).when(a < 0, float("-inf"))
    return F.when(b == 0, zero).otherwise(a / F.nullif(b, F.lit(0.0)))


def floor_divide(a: Column, b: Column) -> Column:
    """Floor division; whole numbers stay exact; by zero null."""
    b = F.nullif(b, b * 0)
    return (a - floor_mod(a, b)) / b


def floor_mod(a: Column, b: Column) -> Column:
    """Remainder with the divisor's sign; by zero null."""
    b = F.nullif(b, b * 0)
    r = a % b
    return F.when((r != 0) & ((r < 0) != (b < 0)), r + b).otherwise(r)


def _whole(kind: T.DataType) -> bool:
    return isinstance(kind, T.IntegralType)


def _text(kind: T.DataType) -> bool:
    return isinstance(kind, T.StringType)


@column("+")
def add(a, b):
    def build(c: Context, x, y):
        x, y = col(x), col(y)
        if _text(c.kind(x)) or _text(c.kind(y)):
            return F.concat(x.cast("string"), y.cast("string"))
        if isinstance(c.kind(x), T.DateType) and _whole(c.kind(y)):
            return F.date_add(x, y.cast("int"))
        return x + y

    return typed_row(build, a, b)


@column("-")
def subtract(a, b):
    def build(c: Context, x, y):
        x, y = col(x), col(y)
        return F.date_sub(x, y.cast("int")) if isinstance(c.kind(x), T.DateType) and _whole(c.kind(y)) else x - y

    return typed_row(build, a, b)


COLUMN["/"] = lambda a, b: by_row(lambda x, y: divide(col(x), col(y)), a, b)


@column("div")
def div(a, b):
    def build(c: Context, x, y):
        x, y = col(x), col(y)
        whole = _whole(c.kind(x)) and _whole(c.kind(y))
        return floor_divide(x, y).cast("long") if whole else F.floor(x / F.nullif(y, F.lit(0.0))).cast("double")

    return typed_row(build, a, b)


COLUMN["mod"] = lambda a, b: by_row(lambda x, y: floor_mod(col(x), col(y)), a, b)
COLUMN["^"] = lambda value, x: by_row(lambda v, y: F.coalesce(col(y), col(v)), value, x)
COLUMN["log"] = lambda x, base: by_row(lambda v, b: F.ln(col(v)) / F.ln(col(b).cast("double")), x, base)


@column("pow")
def power(a, b):
    def build(c: Context, x, y):
        x, y = col(x), col(y)
        out = F.pow(x, y)
        return out.cast("long") if _whole(c.kind(x)) and _whole(c.kind(y)) else out

    return typed_row(build, a, b)


@column("round")
def round_(a, b):
    x, n = (a, b) if isinstance(a, Expr) else (b, a)
    return by_row(lambda v: F.round(v, int(n)), x)


@column("xbar")
def xbar(bar, series):
    """Values down to a multiple of the bar; a time span cuts timestamps."""

    def build(c: Context, size, x):
        x = col(x)
        if isinstance(size, dt.timedelta):
            step, kind = int(size / dt.timedelta(microseconds=1)), c.kind(x)
            micros = F.unix_micros(x.cast("timestamp"))
            return F.timestamp_micros(floor_divide(micros, F.lit(step)).cast("long") * step).cast(kind)
        size = col(size)
        if _whole(c.kind(x)) and _whole(c.kind(size)):
            return x - floor_mod(x, size)
        return F.floor(x / size) * size

    return typed_row(build, bar, series)


rows(
    abs=F.abs, acos=F.acos, acosh=F.acosh, asin=F.asin, asinh=F.asinh, atan=F.atan, atanh=F.atanh, cbrt=F.cbrt, cos=F.cos, cosh=F.cosh, cot=F.cot,
    exp=F.exp, ln=F.ln, log10=F.log10, log1p=F.log1p, sign=F.signum, sin=F.sin, sinh=F.sinh, sqrt=F.sqrt, tan=F.tan, tanh=F.tanh,
    ceil=lambda x: F.ceil(x).cast("double"), floor=lambda x: F.floor(x).cast("double"),
    clip=lambda x, lo, hi: F.when(x.isNotNull(), F.greatest(F.least(x, hi), lo)),
    hash=F.xxhash64,
)
COLUMN["neg"] = lambda a: typed_row(lambda c, x: ~col(x) if isinstance(c.kind(col(x)), T.BooleanType) else -col(x), a)

#: Type names of casts, and parts of dates and times.
TYPES = {
    "bool": "boolean", "u8": "smallint", "u16": "int", "u32": "bigint", "u64": "decimal(20,0)", "i8": "tinyint", "i16": "smallint", "i32": "int",
    "i64": "bigint", "i128": "decimal(38,0)", "f32": "float", "f64": "double", "date": "date", "timestamp": "timestamp_ntz", "datetime": "timestamp_ntz",
    "time": "time(6)", "duration": "interval day to second", "sym": "string", "cat": "string", "str": "string",
}
PARTS: dict[str, Callable[[Column], Column]] = {
    "year": F.year, "quarter": F.quarter, "month": F.month, "day": F.day, "hour": F.hour, "minute": F.minute,
    "month_start": lambda x: F.trunc(x, "month"), "month_end": F.last_day, "weekday": lambda x: F.weekday(x) + 1,
    "second": lambda x: F.floor(F.date_part(F.lit("SECOND"), x)).cast("int"),
    "ms": lambda x: F.floor(F.date_part(F.lit("SECOND"), x) % 1 * 1000).cast("int"),
    "ns": lambda x: (F.date_part(F.lit("SECOND"), x) % 1 * 1_000_000_000).cast("int"),
}


@column("$")
def cast(name, x):
    if name in PARTS:
        return by_row(lambda v: PARTS[name](col(v)), x)
    if name not in TYPES:
        raise ValueError(f"no type or part {name!r}")
    return by_row(lambda v: col(v).cast(TYPES[name]), x)


# aggregates


def listed(c: Column) -> Column:
    return F.collect_list(c)


def midpoint(values: Column, q: float) -> Column:
    """Between two values of a sorted array their mean, whatever the fraction."""
    p = (F.size(values) - 1) * F.lit(float(q))
    at = lambda x: F.get(values, x.cast("int")).cast("double")
    return (at(F.floor(p)) + at(F.ceil(p))) / 2


def aggregates(**table: Callable[..., Column]) -> None:
    for name, fn in table.items():
        COLUMN[name] = lambda *a, fn=fn: aggregate(fn, *a)


aggregates(
    corr=F.corr, cov0=F.covar_pop, cov1=F.covar_samp, kurtosis=F.kurtosis, skew=F.skewness, max=F.max, min=F.min, mean=F.avg, prod=F.product,
    std0=F.stddev_pop, std1=F.stddev_samp, var0=F.var_pop, var1=F.var_samp,
)


def composed(name: str, fn: Callable[..., Column], *parts: Callable[..., Column]) -> None:
    """A function of several aggregates of the same arguments."""
    COLUMN[name] = lambda *a: by_row(fn, *(aggregate(p, *a) for p in parts))


composed("sum", lambda s: F.coalesce(s, s * 0, F.lit(0)), F.sum)
composed("all", lambda b: F.coalesce(b, F.lit(True)), F.bool_and)
composed("any", lambda b: F.coalesce(b, F.lit(False)), F.bool_or)
composed("wsum", lambda s: F.coalesce(s, F.lit(0)), lambda w, x: F.sum(w * x))
composed("wmean", divide, lambda w, x: F.sum(w * x), lambda w, x: F.sum(w))
COLUMN["uc"] = lambda x: by_row(lambda n, nulls: n + nulls, _distinct(x), aggregate(lambda v: F.max(v.isNull().cast("int")), x))
COLUMN["count"] = lambda x: aggregate(lambda *_: F.count(F.lit(1)), *([] if isinstance(x, Expr) and x.virtual else [x]))
COLUMN["median"] = lambda x: aggregate(lambda v: F.percentile(v, 0.5), x)
COLUMN["mode"] = lambda x: aggregate(lambda v: F.mode(v, True), x)


def _distinct(x) -> Expr:
    """Distinct non-null values; windows have no count(distinct), so there a set is counted."""

    def build(c: Context) -> Column:
        v = c.plain(x)
        return F.count_distinct(v) if c.group else F.size(F.collect_set(v).over(c.whole()))

    return Expr(build, x.name, agg=True)


@column("quantile")
def quantile(a, b):
    x, q = (a, b) if isinstance(a, Expr) else (b, a)
    return by_row(lambda v: midpoint(F.array_sort(v), q), aggregate(listed, x))


COLUMN["top"] = lambda k, x: by_row(lambda v: F.slice(F.sort_array(v, False), 1, int(k)), aggregate(listed, x))
COLUMN["bottom"] = lambda k, x: by_row(lambda v: F.slice(F.array_sort(v), 1, int(k)), aggregate(listed, x))
COLUMN["asc"] = lambda x: by_row(lambda v: F.array_sort(v), aggregate(listed, x))
COLUMN["desc"] = lambda x: by_row(lambda v: F.sort_array(v, False), aggregate(listed, x))


def _everything(c: Context):
    return c.ordered().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


COLUMN["first"] = lambda x: ordered_aggregate(lambda c, v: F.min_by(F.struct(v.alias("v")), c.position())["v"], lambda c, v: F.first(v).over(_everything(c)), x)
COLUMN["last"] = lambda x: ordered_aggregate(lambda c, v: F.max_by(F.struct(v.alias("v")), c.position())["v"], lambda c, v: F.last(v).over(_everything(c)), x)


def in_order(c: Context, v: Column) -> Column:
    """A group's values as an array in row order, nulls kept."""
    pairs = F.collect_list(F.struct(c.position().alias("o"), v.alias("v")))
    return F.transform(F.array_sort(pairs if c.group else pairs.over(c.whole())), lambda p: p["v"])


def ordered_list(x) -> Expr:
    return ordered_aggregate(in_order, in_order, x)


COLUMN["unique"] = lambda x: by_row(F.array_distinct, ordered_list(x))


@column("#")
def take(n, x):
    n = int(n)
    return by_row(lambda v: F.slice(v, 1, n) if n >= 0 else F.slice(v, F.greatest(F.size(v) + n + 1, F.lit(1)), F.lit(-n)), ordered_list(x))


@column("_")
def drop(n, x):
    n = int(n)
    return by_row(lambda v: F.slice(v, F.lit(n + 1), F.size(v)) if n >= 0 else F.slice(v, F.lit(1), F.greatest(F.size(v) + n, F.lit(0))), ordered_list(x))


@column("ss")
def search_left(x, values):
    return _search(lambda v, s: v < s, x, values)


@column("ssr")
def search_right(x, values):
    return _search(lambda v, s: v <= s, x, values)


def _search(before, x, values):
    many = isinstance(values, list)
    counts = [aggregate(lambda v, s=s: F.count_if(before(v, literal(s))), x) for s in (values if many else [values])]
    return by_row(lambda *n: F.array(*n) if many else n[0], *counts)


# ordered analytics

_ROLLING: dict[str, Callable[[Column], Column]] = {
    "mmax": F.max, "mmin": F.min, "mmean": F.avg, "msum": F.sum, "mskew": F.skewness, "mstd0": F.stddev_pop, "mstd1": F.stddev_samp,
    "mvar0": F.var_pop, "mvar1": F.var_samp, "mmedian": lambda v: F.percentile(v, 0.5),
}
_RUNNING: dict[str, Callable[[Column], Column]] = {"cmax": F.max, "cmin": F.min, "cprod": F.product, "csum": F.sum}


def _rolling(fn):
    def build(n, x):
        if int(n) <= 0:
            raise ValueError("a moving window has one row at least")
        return windowed(lambda c, v: fn(v).over(c.last_rows(n)), x)

    return build


COLUMN |= {name: _rolling(fn) for name, fn in _ROLLING.items()}
COLUMN |= {name: (lambda x, fn=fn: windowed(lambda c, v: F.when(v.isNotNull(), fn(v).over(c.running())), x)) for name, fn in _RUNNING.items()}
COLUMN["ccount"] = lambda x: windowed(lambda c, v: F.count(v).over(c.running()), x)
COLUMN["mquantile"] = lambda q, n, x: windowed(lambda c, v: midpoint(F.array_sort(F.collect_list(v).over(c.last_rows(n))), q), x)
COLUMN["prev"] = lambda x: windowed(lambda c, v: F.lag(v).over(c.ordered()), x)
COLUMN["next"] = lambda x: windowed(lambda c, v: F.lead(v).over(c.ordered()), x)
COLUMN["diff"] = lambda x: windowed(lambda c, v: v - F.lag(v).over(c.ordered()), x)
COLUMN["pc"] = lambda x: windowed(lambda c, v: divide(v - F.lag(v).over(c.ordered()), F.lag(v).over(c.ordered())), x)
COLUMN["fill"] = lambda x: windowed(lambda c, v: F.last(v, True).over(c.running()), x)
COLUMN["bfill"] = lambda x: windowed(lambda c, v: F.first(v, True).over(c.ordered().rowsBetween(0, Window.unboundedFollowing)), x)
COLUMN["rank"] = lambda x: windowed(lambda c, v: F.when(v.isNotNull(), F.row_number().over(c.ordered(v.isNull(), v))), x)
COLUMN["reverse"] = lambda x: windowed(lambda c, v: c.take(v, lambda at, n: n - 1 - at), x)
COLUMN["shuffle"] = lambda x, seed=None: windowed(lambda c, v: _shuffled(c, v, seed), x)
COLUMN["rotate"] = lambda n, x: windowed(lambda c, v: c.take(v, lambda at, size: F.pmod(at + int(n), size)), x)


def _shuffled(c: Context, v: Column, seed) -> Column:
    at = c.stage(F.row_number().over(Window.partitionBy(*c.keys).orderBy(c.stage(F.rand(seed)))) - 1)
    return c.take(v, lambda *_: at)


@column("shift")
def shift(a, b):
    x, n = (a, int(b)) if isinstance(a, Expr) else (b, int(a))
    return windowed(lambda c, v: F.lag(v, n).over(c.ordered()) if n >= 0 else F.lead(v, -n).over(c.ordered()), x)


@column("interp")
def interp(x):
    def build(c: Context, v):
        at = c.stage(F.row_number().over(c.ordered()))
        ahead = c.ordered().rowsBetween(0, Window.unboundedFollowing)
        known = F.when(v.isNotNull(), at)
        lo, hi = F.last(v, True).over(c.running()), F.first(v, True).over(ahead)
        i, j = F.last(known, True).over(c.running()), F.first(known, True).over(ahead)
        return F.when(v.isNotNull(), v.cast("double")).otherwise(lo + (hi - lo) * (at - i) / F.nullif(j - i, F.lit(0)))

    return windowed(build, x)


def _decayed(alpha: float, spread: bool) -> Callable:
    """Exponentially weighted means, or sample variances, as pandas makes them (adjusted; null, NaN and infinity don't
    count). Nested, so that executors get it by value."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        keep, none = 1.0 - 1.0 / (1.0 + (1.0 - alpha) / alpha), float("nan")
        keep2 = keep * keep
        mean = old = var = total = squares = value = none
        for values, opens in batches:
            out = []
            for x, opening in zip(values.to_numpy(zero_copy_only=False).tolist(), opens.to_numpy(zero_copy_only=False).tolist(), strict=True):
                if opening:
                    mean = value = none
                if x - x == 0.0:
                    if mean != mean:
                        mean, old, var, total, squares = x, 1.0, 0.0, 1.0, 1.0
                    else:
                        before, old = mean, old * keep
                        if x != before:
                            mean = (old * before + x) / (old + 1.0)
                        if spread:
                            a, b = before - mean, x - mean
                            var = (old * (var + a * a) + b * b) / (old + 1.0)
                            total, squares = total * keep + 1.0, squares * keep2 + 1.0
                        old += 1.0
                    if spread:
                        rest = total * total - squares
                        value = total * total / rest * var if rest > 0.0 else none
                    else:
                        value = mean
                out.append(value)
            yield pa.array(out, pa.float64(), from_pandas=True)

    return run


def _weighted(name: str):
    def build(alpha, x):
        alpha = float(alpha)
        if not 0 < alpha <= 1:
            raise ValueError("a weight is over 0 and at most 1")
        root = F.sqrt if name == "estd" else lambda v: v
        return windowed(lambda c, v: root(c.scan(v.cast("double"), _decayed(alpha, name != "emean"))), x)

    return build


COLUMN |= {name: _weighted(name) for name in ("emean", "estd", "evar")}


@column("fby")
def fby(x, keys):
    """An expression over the partitions of other columns."""
    keys = keys if isinstance(keys, list) else [keys]

    def build(c: Context):
        inner = Context(c.df, c.order_names, [k.build(c.by_row()) if isinstance(k, Expr) else F.col(f"`{k}`") for k in keys])
        inner.holder = c.holder
        return x.build(inner)

    return Expr(build, x.name, win=True)


# strings

rows(lowercase=F.lower, uppercase=F.upper, trims=lambda x: F.regexp_replace(x, r"^\s+", ""), trime=lambda x: F.regexp_replace(x, r"\s+$", ""), trim=lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))


@column("match")
def match(text, pattern):
    return by_row(lambda x: F.regexp_count(x, F.lit(re.escape(pattern))), text)


@column("join")
def join(a, b):
    """The elements of a list column in one text."""
    x, sep = (a, b) if isinstance(a, Expr) else (b, a)
    return by_row(lambda v: F.array_join(v.cast("array<string>"), str(sep)), x)


@column("split")
def split(a, b):
    x, sep = (a, b) if isinstance(a, Expr) else (b, a)
    return by_row(lambda v: F.split(v, re.escape(sep)), x)


@column("pad")
def pad(a, b):
    """To at least that many characters: n > 0 on the left, n < 0 on the right; longer text stays."""
    x, n = (a, int(b)) if isinstance(a, Expr) else (b, int(a))
    return by_row(lambda v: F.when(F.length(v) >= abs(n), v).otherwise(F.lpad(v, n, " ") if n > 0 else F.rpad(v, -n, " ")), x)


COLUMN["concat"] = lambda sep, a, b: by_row(lambda x, y: F.concat(col(x), F.lit(str(sep)), col(y)), a, b)


@column("replace")
def replace(text, pattern, value):
    """The first match of a regular expression."""
    return by_row(lambda x: F.regexp_replace(x, f"(?s)^(.*?)(?:{pattern})", "$1" + re.escape(value).replace("\\ ", " ")), text)


# time zones: wall clocks without zones

COLUMN["utc"] = lambda x, zone: by_row(lambda v: F.convert_timezone(literal(zone), F.lit("UTC"), col(v)), x)
COLUMN["local"] = lambda x, zone: by_row(lambda v: F.convert_timezone(F.lit("UTC"), literal(zone), col(v)), x)
COLUMN["tz"] = lambda x, a, b: by_row(lambda v, f, t: F.convert_timezone(col(f), col(t), col(v)), x, a, b)


# lists

COLUMN["++"] = lambda a, b: typed_row(lambda c, x, y: F.concat(*(v if isinstance(c.kind(v), T.ArrayType) else F.array(v) for v in (col(x), col(y)))), a, b)
COLUMN["union"] = lambda a, b: by_row(lambda x, y: F.array_union(col(x), col(y)), a, b)
COLUMN["intersect"] = lambda a, b: by_row(lambda x, y: F.array_intersect(col(x), col(y)), a, b)
COLUMN["differ"] = lambda a, b: by_row(lambda x, y: F.array_except(col(x), col(y)), a, b)
COLUMN["flatten"] = lambda x: by_row(F.explode, x)


@column("@")
def at(x, index):
    """Elements of a list column; negative positions count from the end, beyond it null."""
    one = lambda v, i: F.try_element_at(v, F.when(i >= 0, i + 1).otherwise(i))
    return by_row(lambda v: F.array(*(one(v, F.lit(i)) for i in index)) if isinstance(index, list) else one(v, F.lit(index)), x)


@column("reshape")
def reshape(shape, x):
    n, m = shape
    return by_row(lambda v: F.transform(F.sequence(F.lit(0), F.lit(int(n) - 1)), lambda i: F.slice(v, i * int(m) + 1, F.lit(int(m)))), ordered_list(x))


def _fold(x: Column, start: Column, step) -> Column:
    return F.aggregate(F.filter(x, lambda v: v.isNotNull()), start, step)


def _moments(x: Column, ddof: int) -> Column:
    x = F.filter(x, lambda v: v.isNotNull())
    n = F.size(x)
    mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.nullif(n, F.lit(0))
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)) / F.when(n > ddof, n - ddof)


def _at(x: Column, i: Column) -> Column:
    return F.get(x, i)


EACH: dict[str, Callable[[Column], Column]] = {
    "sum": lambda x: _fold(x, F.lit(0.0), lambda a, v: a + v), "any": lambda x: F.exists(x, lambda v: F.coalesce(v, F.lit(False))),
    "all": lambda x: F.forall(x, lambda v: F.coalesce(v, F.lit(True))), "count": F.size, "max": F.array_max, "min": F.array_min,
    "mean": lambda x: _fold(x, F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size(F.filter(x, lambda v: v.isNotNull())), F.lit(0)),
    "median": lambda x: midpoint(F.array_sort(F.filter(x, lambda v: v.isNotNull())), 0.5),
    "std0": lambda x: F.sqrt(_moments(x, 0)), "std1": lambda x: F.sqrt(_moments(x, 1)), "var0": lambda x: _moments(x, 0), "var1": lambda x: _moments(x, 1),
    "asc": F.array_sort, "desc": lambda x: F.sort_array(x, False), "unique": F.array_distinct, "uc": lambda x: F.size(F.array_distinct(x)),
    "first": lambda x: F.get(x, F.lit(0)), "last": lambda x: F.try_element_at(x, F.lit(-1)),
    "diff": lambda x: F.transform(x, lambda v, i: v - F.when(i > 0, F.get(x, i - 1))),
}


@column("each")
def each(fn, x):
    name = getattr(fn, "name", fn)
    if name not in EACH:
        raise ValueError(f"each takes one of {', '.join(EACH)} on a list column")
    return by_row(EACH[name], x)


COLUMN["as"] = lambda x, name: x.alias(str(name))
