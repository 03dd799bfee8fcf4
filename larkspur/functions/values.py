"""Driver-side forms of the built-ins: values, frames, files, tables, ticks, jobs and the system.

Each takes the interpreter, the scope and its arguments. One that can't work on what it gets raises
NotImplementedError, and the column form is tried over a small frame.
"""

from __future__ import annotations

import bisect
import datetime as dt
import glob
import logging
import operator
import os
import re
import time
import zoneinfo
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import numpy as np
from pyspark.sql import functions as F

from larkspur import __version__
from larkspur.functions.columns import COLUMN, PARTS, TYPES
from larkspur.lang.lexer import Sym
from larkspur.operators import joins, reshape
from larkspur.plans.expr import Context, Expr
from larkspur.plans.frame import Frame, from_columns, quoted
from larkspur.sources import files, partitioned

VALUES: dict[str, Callable[..., Any]] = {}
log = logging.getLogger("larkspur")


def value(*names: str):
    def keep(fn):
        for n in names:
            VALUES[n] = fn
        return fn

    return keep


def plain(**table: Callable[..., Any]) -> None:
    for name, fn in table.items():
        VALUES[name.replace("__", ".")] = lambda i, s, *a, fn=fn: fn(*a)


def syms(x: Any) -> list[str]:
    return [str(x)] if isinstance(x, str) else [str(v) for v in (x or [])]


def frame(i, x) -> Frame:
    from larkspur.plans.evaluate import frame_of

    if isinstance(x, str):
        x = i.engine.get_var(str(x))
    return frame_of(x, i.engine.spark)


# elementwise operators on numbers, lists and dicts


def spread(fn: Callable[[Any, Any], Any]):
    def run(a, b):
        if isinstance(a, dict) or isinstance(b, dict):
            keys = list(dict.fromkeys([*(a if isinstance(a, dict) else []), *(b if isinstance(b, dict) else [])]))
            pick = lambda x, k: x.get(k) if isinstance(x, dict) else x
            return {k: run(pick(a, k), pick(b, k)) for k in keys}
        if isinstance(a, list) and isinstance(b, list):
            if len(a) != len(b):
                raise ValueError(f"lists of {len(a)} and {len(b)}")
            return [run(x, y) for x, y in zip(a, b, strict=True)]
        if isinstance(a, list):
            return [run(x, b) for x in a]
        if isinstance(b, list):
            return [run(a, y) for y in b]
        if isinstance(a, Frame) or isinstance(b, Frame):
            raise NotImplementedError
        return fn(a, b)

    return lambda i, s, a, b: run(a, b)


def _add(a, b):
    if a is None or b is None:
        return None
    if isinstance(a, str) or isinstance(b, str):
        return str(a) + str(b)
    if isinstance(a, dt.date) and not isinstance(a, dt.datetime):
        return dt.datetime.combine(a, dt.time()) + b if isinstance(b, dt.timedelta) and b % dt.timedelta(days=1) else a + (b if isinstance(b, dt.timedelta) else dt.timedelta(days=b))
    return a + b


def _numeric(fn):
    def run(a, b):
        if a is None or b is None:
            return None
        if isinstance(a, str) or isinstance(b, str):
            raise TypeError(f"Unsupported binary op on {type(a).__name__} and {type(b).__name__}")
        return fn(a, b)

    return run


def _subtract(a, b):
    return a - dt.timedelta(days=b) if isinstance(a, dt.date) and isinstance(b, int) else a - b


def _true_divide(a, b):
    if isinstance(a, dt.timedelta) or isinstance(b, dt.timedelta):
        return a / b
    return a / b if b else float("nan") if not a or a != a else float("inf") if a > 0 else float("-inf")


def _compare(fn):
    return lambda a, b: None if a is None or b is None else fn(a, b)


for _name, _fn in {
    "+": _add, "-": _numeric(_subtract), "*": _numeric(operator.mul), "/": _numeric(_true_divide),
    "div": _numeric(lambda a, b: None if not b else a // b), "mod": _numeric(lambda a, b: None if not b else a % b),
    "<": _compare(operator.lt), "<=": _compare(operator.le), ">": _compare(operator.gt), ">=": _compare(operator.ge),
    "=": lambda a, b: a == b, "!=": lambda a, b: a != b, "pow": _numeric(operator.pow),
    "|": lambda a, b: max((x for x in (a, b) if x is not None), default=None), "&": lambda a, b: min((x for x in (a, b) if x is not None), default=None),
    "^": lambda v, x: v if x is None else x,
}.items():
    VALUES[_name] = spread(_fn)


def same(a: Any, b: Any) -> bool:
    if isinstance(a, Frame) and isinstance(b, Frame):
        return a.columns == b.columns and a.collect() == b.collect()
    return type(a) is type(b) and a == b or isinstance(a, str) and isinstance(b, str) and str(a) == str(b)


VALUES["~"] = lambda i, s, a, b: same(a, b)


@value("not")
def not_(i, s, x):
    return [not_(i, s, v) for v in x] if isinstance(x, list) else not x


@value("neg")
def neg(i, s, x):
    if isinstance(x, (list, dict)):
        return [neg(i, s, v) for v in x] if isinstance(x, list) else {k: neg(i, s, v) for k, v in x.items()}
    return not x if isinstance(x, bool) else None if x is None else -x


@value("null")
def null(i, s, x):
    return [null(i, s, v) for v in x] if isinstance(x, list) else x is None or x == "" or x != x


@value("in")
def in_(i, s, x, values):
    values = values if isinstance(values, list) else [values]
    if isinstance(x, Frame):
        raise NotImplementedError
    return [v in values for v in x] if isinstance(x, list) else x in values


@value("within")
def within(i, s, x, bounds):
    one = lambda v: v is not None and bounds[0] <= v <= bounds[1]
    return [one(v) for v in x] if isinstance(x, list) else one(x)


@value("like")
def like(i, s, x, pattern):
    return [bool(re.search(pattern, v)) for v in x] if isinstance(x, list) else bool(re.search(pattern, x))


@value("filter")
def filter_(i, s, x):
    return [k for k, v in x.items() if v] if isinstance(x, dict) else [k for k, v in enumerate(x) if v]


@value("assert")
def assert_(i, s, x):
    if not x:
        raise AssertionError("assert")
    return True


@value("equal")
def equal(i, s, a, b):
    if not same(a, b):
        raise AssertionError(f"{a!r} is not {b!r}")
    return True


@value("fail")
def fail(i, s, call, pattern=""):
    """Whether evaluating the call raises an error that matches the pattern."""
    try:
        evaluate(i, s, call)
    except Exception as e:
        if re.search(pattern, str(e)):
            return True
        raise
    raise AssertionError("no error was raised")


# lists, dicts, frames


@value("count")
def count(i, s, x):
    return frame(i, x).data.count() if isinstance(x, (Frame, partitioned.PartTable)) else len(x) if isinstance(x, (list, dict)) else 1


def _end(k: int, name: str):
    def run(i, s, x):
        if isinstance(x, Frame):
            rows = i.limit(x, 1 if k == 0 else -1).collect()
            return {Sym(n): v for n, v in rows[0].items()} if rows else None
        if isinstance(x, dict):
            x = list(x.values())
        return (x[k] if x else None) if isinstance(x, list) else x

    VALUES[name] = run


_end(0, "first")
_end(-1, "last")


def reducer(name: str, fn: Callable[[list], Any]) -> None:
    def run(i, s, x):
        if not isinstance(x, (list, dict)):
            raise NotImplementedError
        return fn([v for v in (x.values() if isinstance(x, dict) else x) if v is not None])

    VALUES[name] = run


for _name, _fn in {"sum": lambda v: sum(v), "max": lambda v: max(v, default=None), "min": lambda v: min(v, default=None), "mean": lambda v: sum(v) / len(v) if v else None, "all": all, "any": any, "prod": lambda v: np.prod(v).item() if v else 1}.items():
    reducer(_name, _fn)


def sized(n: int, x: list) -> list:
    """The first or last n; taking more than there is goes round."""
    if abs(n) <= len(x):
        return x[:n] if n >= 0 else x[n:]
    return [x[k % len(x)] for k in range(n)] if x else []


@value("#")
def take(i, s, n, x):
    if isinstance(n, list) and all(isinstance(v, int) for v in n):
        return VALUES["reshape"](i, s, n, x)
    if isinstance(n, str) or isinstance(n, list):
        names = syms(n)
        return {k: v for k, v in x.items() if k in names} if isinstance(x, dict) else Frame(frame(i, x).data.select(*map(quoted, names)))
    if isinstance(x, Frame):
        return i.limit(x, n)
    return sized(n, x if isinstance(x, list) else [x])


@value("_")
def drop(i, s, n, x):
    if isinstance(n, (str, list)):
        names = syms(n)
        return {k: v for k, v in x.items() if k not in names} if isinstance(x, dict) else Frame(x.data.drop(*names), x.order)
    if isinstance(x, Frame):
        rows = reshape.indexed(x)
        total = rows.count()
        return Frame(rows.where(F.col("__i") >= n if n >= 0 else F.col("__i") < total + n), ["__i"])
    return x[n:] if n >= 0 else x[:n]


@value("?")
def query(i, s, n, x):
    """n random draws from a list or below a number; -n without repetition; a null n shuffles; a list or dict is searched."""
    rng = i.engine.random
    if isinstance(n, (list, dict)):
        keys = list(n.values()) if isinstance(n, dict) else n
        names = list(n) if isinstance(n, dict) else range(len(n))
        find = lambda v: next((k for k, w in zip(names, keys, strict=True) if w == v), None if isinstance(n, dict) else len(n))
        return [find(v) for v in x] if isinstance(x, list) else find(x)
    pool = x if isinstance(x, list) else None
    if n is None:
        return rng.sample(pool, len(pool))
    if n < 0:
        return rng.sample(pool if pool is not None else range(x), -n)
    if pool is not None:
        return rng.choices(pool, k=n)
    return [rng.random() * x for _ in range(n)] if isinstance(x, float) else [rng.randrange(x) for _ in range(n)]


@value("$")
def cast(i, s, name, x):
    if isinstance(x, list) and not x:
        return []
    if name in ("sym", "cat", "str") and not isinstance(x, list):
        return (Sym if name != "str" else str)(x)
    if isinstance(x, (bool, int, float)) and name in TYPES and (name[0] in "iu" or name in ("f64", "f32", "bool")):
        return bool(x) if name == "bool" else float(x) if name[0] == "f" else int(x)
    if name not in TYPES and name not in PARTS:
        raise ValueError(f"no type or part {name!r}")
    raise NotImplementedError


@value("@")
def at(i, s, x, k):
    if isinstance(x, dict):
        return [x.get(v) for v in k] if isinstance(k, list) else x.get(k)
    if isinstance(x, Frame):
        if isinstance(k, str):
            return [r[0] for r in x.sorted().select(quoted(k)).collect()]
        if isinstance(k, list) and k and isinstance(k[0], str):
            return Frame(x.data.select(*map(quoted, syms(k)), *(quoted(o) for o in x.order if o.startswith("__"))), [o for o in x.order if o.startswith("__") or o in k])
        rows = reshape.indexed(x)
        total = rows.count()
        return Frame(rows.where(F.col("__i").isin([v if v >= 0 else v + total for v in (k if isinstance(k, list) else [k])])), ["__i"])
    if isinstance(k, list):
        return [at(i, s, x, v) for v in k]
    return x[k] if isinstance(x, (list, str)) and -len(x) <= k < len(x) else None


@value(".")
def deep(i, s, x, keys):
    for k in keys if isinstance(keys, list) else [keys]:
        x = at(i, s, x, k)
    return x


@value("!")
def make_dict(i, s, keys, values):
    keys, values = (x if isinstance(x, list) else [x] for x in (keys, values))
    if len(keys) != len(values):
        raise ValueError("keys and values of unequal number")
    return dict(zip(keys, values, strict=True))


@value("++")
def concat(i, s, a, b):
    if isinstance(a, Frame):
        return reshape.stack(a, frame(i, b))
    if isinstance(a, dict):
        return a | b
    return (a if isinstance(a, list) else [a]) + (b if isinstance(b, list) else [b])


@value("reshape")
def reshape_(i, s, shape, x):
    n, m = shape
    x = x if isinstance(x, list) else [x]
    flat = sized(n * m, x)
    return [flat[k * m : (k + 1) * m] for k in range(n)]


@value("range")
def range_(i, s, x):
    if not isinstance(x, list):
        return list(range(x))
    a, b = x
    return [a + dt.timedelta(days=k) for k in range((b - a).days + 1)] if isinstance(a, dt.date) else list(range(a, b))


@value("rotate")
def rotate(i, s, n, x):
    if not isinstance(x, list):
        raise NotImplementedError
    n %= max(len(x), 1)
    return x[n:] + x[:n]


@value("cross")
def cross(i, s, a, b):
    a, b = (x if isinstance(x, list) else [x] for x in (a, b))
    return [[x, y] for x in a for y in b]


@value("intersect")
def intersect(i, s, a, b):
    return [x for x in a if x in b] if isinstance(a, list) else joins.semi_join(frame(i, a).columns, frame(i, a), frame(i, b))


@value("differ")
def differ(i, s, a, b):
    return [x for x in a if x not in b] if isinstance(a, list) else joins.anti_join(frame(i, a).columns, frame(i, a), frame(i, b))


@value("union")
def union(i, s, a, b):
    if not isinstance(a, list) or not isinstance(b, list):
        raise NotImplementedError
    return list(dict.fromkeys([*a, *b]))


@value("unique")
def unique(i, s, x):
    return reshape.unique(x) if isinstance(x, Frame) else list(dict.fromkeys(x))


@value("enlist")
def enlist(i, s, x):
    return from_columns(i.engine.spark, {"col00": x}) if isinstance(x, list) else [x]


@value("each")
def each(i, s, f, x):
    if isinstance(x, dict):
        return {k: i.call(s, f, [v]) for k, v in x.items()}
    return [i.call(s, f, [v]) for v in x]


@value("parallel")
def parallel(i, s, f, x):
    """As each, on threads: each may run a Spark job of its own."""
    with ThreadPoolExecutor(8) as pool:
        return list(pool.map(lambda v: i.call(s, f, [v]), x))


@value("over")
def over(i, s, f, start, x):
    """A number of rounds applies f so many times; a list is folded."""
    if isinstance(x, list):
        for v in x:
            start = i.call(s, f, [start, v])
        return start
    for _ in range(x):
        start = i.call(s, f, [start])
    return start


@value("scan")
def scan(i, s, f, start, x):
    out = []
    for v in x if isinstance(x, list) else range(x):
        start = i.call(s, f, [start, v] if isinstance(x, list) else [start])
        out.append(start)
    return out


@value("ss")
def search_left(i, s, x, v):
    return [bisect.bisect_left(x, y) for y in v] if isinstance(v, list) else bisect.bisect_left(x, v)


@value("ssr")
def search_right(i, s, x, v):
    return [bisect.bisect_right(x, y) for y in v] if isinstance(v, list) else bisect.bisect_right(x, v)


@value("replace")
def replace(i, s, x, pattern, new):
    """On one text all matches; on a list the first of each."""
    if isinstance(x, list):
        return [re.sub(pattern, lambda m: new, v, count=1) for v in x]
    return re.sub(pattern, lambda m: new, x)


@value("pad")
def pad(i, s, n, x):
    one = lambda v: v.ljust(n) if n > 0 else v.rjust(-n)
    return [one(v) for v in x] if isinstance(x, list) else one(x)


@value("match")
def match(i, s, x, pattern):
    one = lambda v: len(re.findall(pattern, v))
    return [one(v) for v in x] if isinstance(x, list) else one(x)


plain(
    join=lambda sep, x: str(sep).join(map(str, x)), split=lambda sep, x: [v.split(sep) for v in x] if isinstance(x, list) else x.split(sep),
    key=lambda x: list(x), value=lambda x: list(x.values()), type=lambda x: Sym(type_name(x)), inv=lambda m: np.linalg.inv(np.array(m, float)).tolist(),
    reverse=lambda x: x[::-1], asc=lambda x: sorted(x, key=lambda v: (v is not None, v)), desc=lambda x: sorted((v for v in x if v is not None), reverse=True) + [v for v in x if v is None],
)
for _name in ("reverse", "asc", "desc"):
    VALUES[_name] = lambda i, s, x, fn=VALUES[_name], name=_name: fn(i, s, x) if isinstance(x, list) else Frame(x.ordered().data.orderBy(*(quoted(o).desc() for o in x.ordered().order)).withColumn("__row", F.monotonically_increasing_id()), ["__row"])


@value("shuffle")
def shuffle(i, s, x):
    if isinstance(x, Frame):
        return Frame(x.data.withColumn("__rand", F.rand(i.engine.random.randrange(1 << 31))), ["__rand"])
    return i.engine.random.sample(x, len(x))


def type_name(x: Any) -> str:
    if isinstance(x, list):
        kinds = {type_name(v) for v in x}
        return f"{kinds.pop()}s" if len(kinds) == 1 else "mixed_list"
    if isinstance(x, Frame):
        return "df"
    for kind, name in ((bool, "bool"), (int, "i64"), (float, "f64"), (Sym, "sym"), (str, "str"), (dt.datetime, "timestamp"), (dt.date, "date"), (dt.time, "time"), (dt.timedelta, "duration"), (dict, "dict"), (partitioned.PartTable, "par_df"), (type(None), "null")):
        if isinstance(x, kind):
            return name
    return "fn"


# frames: joins and reshaping

for _name, _fn in {"lj": joins.left_join, "ij": joins.inner_join, "fj": joins.full_join, "cj": joins.cross_join, "aj": joins.asof_join, "semi": joins.semi_join, "anti": joins.anti_join}.items():
    VALUES[_name] = lambda i, s, on, a, b, fn=_fn: fn(syms(on), frame(i, a), frame(i, b))


@value("wj")
def wj(i, s, by, time_, start, end, aggregations, a, b):
    """Starts and ends are columns of the left frame; aggregations a dict of names to functions and columns, `[fn, col]`."""
    left, right = frame(i, a), frame(i, b)
    aggs = []
    for name, (fn, c) in aggregations.items():
        e = COLUMN[getattr(fn, "name", str(fn))](Expr(lambda _, c=c: quoted(str(c)), str(c)))
        aggs.append(e.build(Context(right.data, list(right.order), group=True)).alias(str(name)))
    return joins.window_join(syms(by), str(time_), quoted(str(start)), quoted(str(end)), aggs, left, right)


for _name, _fn in {
    "xasc": lambda i, c, x: reshape.sort(syms(c), frame(i, x)), "xdesc": lambda i, c, x: reshape.sort(syms(c), frame(i, x), False),
    "xreorder": lambda i, c, x: reshape.reorder(syms(c), frame(i, x)), "hstack": lambda i, a, b: reshape.side_by_side(frame(i, a), frame(i, b)),
    "xrename": lambda i, c, x: reshape.rename(c if isinstance(c, dict) else syms(c), frame(i, x)), "vstack": lambda i, a, b: reshape.stack(frame(i, a), frame(i, b)),
    "extend": lambda i, a, b: reshape.stack(frame(i, a), frame(i, b)), "explode": lambda i, x, c: reshape.explode(frame(i, x), syms(c)),
    "unpivot": lambda i, x, index, on=None: reshape.unpivot(frame(i, x), syms(index), syms(on)), "describe": lambda i, x: reshape.describe(frame(i, x)),
    "pivot": lambda i, x, index, on, values, how="": reshape.pivot(frame(i, x), syms(index), str(on), str(values), str(how)),
    "flip": lambda i, x: frame(i, x), "collect": lambda i, x: from_rows(i, frame(i, x)), "cols": lambda i, x: [Sym(c) for c in frame(i, x).columns],
}.items():
    VALUES[_name] = lambda i, s, *a, fn=_fn: fn(i, *a)


def from_rows(i, x: Frame) -> Frame:
    return Frame(i.engine.spark.createDataFrame(x.sorted().toArrow())).ordered()


@value("transpose")
def transpose(i, s, x):
    return reshape.transpose(x) if isinstance(x, Frame) else [list(r) for r in zip(*x, strict=True)]


@value("top", "bottom")
def _top(i, s, k, x):
    raise NotImplementedError


@value("schema")
def schema(i, s, x):
    f = frame(i, x)
    return from_columns(i.engine.spark, {"column": list(f.columns), "datatype": [t for _, t in f.df.dtypes], "flag": [sorted_flag(f, c) for c in f.columns]})


def sorted_flag(f: Frame, c: str) -> str:
    return "ascending" if f.order[:1] == [c] else ""


@value("flag")
def flag(i, s, x):
    return {Sym(c): Sym(sorted_flag(frame(i, x), c)) for c in frame(i, x).columns}


@value("show")
def show(i, s, x):
    i.engine.show(x)
    return x


@value("console")
def console(i, s, rows, columns):
    i.engine.display = (rows, columns)


# evaluation and variables


def evaluate(i, s, x):
    if isinstance(x, list) and x:
        head = x[0]
        return i.call(s, head if not isinstance(head, str) else i._id(s, str(head)), x[1:])
    if isinstance(x, Sym):
        return i._id(s, str(x))
    return i.engine.eval(x) if isinstance(x, str) else x


VALUES["eval"] = evaluate
VALUES["evalc"] = lambda i, s, x: i.engine.text_of(evaluate(i, s, x))


@value("evali")
def evali(i, s, x, n):
    out = evaluate(i, s, x)
    return i.limit(out, n) if isinstance(out, Frame) else out


@value("timeit")
def timeit(i, s, x, n):
    """Milliseconds for n evaluations."""
    began = time.perf_counter()
    for _ in range(n):
        evaluate(i, s, x)
    return (time.perf_counter() - began) * 1000


VALUES |= {
    "set": lambda i, s, k, v: i.engine.set_var(str(k), v), "get": lambda i, s, k: i.engine.get_var(str(k), None), "del": lambda i, s, k: i.engine.del_var(str(k)),
    "list": lambda i, s, p="": i.engine.list_vars(str(p)), "tables": lambda i, s, p="": i.engine.table_names(str(p)), "import": lambda i, s, p: i.engine.import_source_path(str(p)),
    "exit": lambda i, s, code=0: i.engine.shutdown(), "load": lambda i, s, p: i.engine.load_partitioned_df(str(p)), "par": lambda i, s, n: i.engine.tables[str(n)],
    ".fn.select": lambda i, s, t, p, w, g, o, n: i.engine.functional_select(t, p, w, g, o, n), ".fn.update": lambda i, s, t, w, g, o: i.engine.functional_update(t, w, g, o),
    ".fn.delete": lambda i, s, t, w, c: i.engine.functional_delete(t, w, c),
}


# time

plain(
    now=lambda zone="UTC": dt.datetime.now(zoneinfo.ZoneInfo(zone or "UTC")).replace(tzinfo=None), today=lambda zone="UTC": dt.datetime.now(zoneinfo.ZoneInfo(zone or "UTC")).date(),
    utc=lambda t, zone: _zone(t, zone, "UTC"), local=lambda t, zone: _zone(t, "UTC", zone), tz=lambda t, a, b: _zone(t, a, b),
)


def _zone(t, a, b):
    if isinstance(t, list):
        return [_zone(x, a, b) for x in t]
    return t.replace(tzinfo=zoneinfo.ZoneInfo(str(a))).astimezone(zoneinfo.ZoneInfo(str(b))).replace(tzinfo=None)


# files and tables on disk

for _name, _fn in {
    "exists": files.exists, "hdel": files.delete, "rcsv": files.read_csv, "rjson": files.read_json, "rparquet": files.read_parquet, "rtxt": files.read_text,
    "rbin": files.read_object, "wbin": files.write_object,
}.items():
    VALUES[_name] = lambda i, s, *a, fn=_fn: fn(i.engine.spark, *a)
VALUES |= {
    "wcsv": lambda i, s, p, x, sep=",": files.write_csv(p, frame(i, x), sep), "wjson": lambda i, s, p, x: files.write_json(p, frame(i, x)),
    "wparquet": lambda i, s, p, x, level=3: files.write_parquet(p, frame(i, x), level),
    "wtxt": lambda i, s, p, x, append=False: files.write_bytes(i.engine.spark, p, "\n".join(x if isinstance(x, list) else [x]).encode() + b"\n", append),
    "wpar": lambda i, s, p, part, t, x, sort=None, rechunk=False, overwrite=False: i.engine.write_partitioned_df(frame(i, x), p, t, part, syms(sort), rechunk, overwrite),
    "wparc": lambda i, s, p, part, t, x, sort=None, rechunk=False, overwrite=False, codec="zstd": i.engine.write_partitioned_df_custom(frame(i, x), p, t, part, syms(sort), rechunk, overwrite, codec),
}


@value("rdatabase", "wdatabase", "rexcel", "wexcel")
def not_offered(i, s, *a):
    raise ValueError("databases and workbooks have no reader or writer here")


# ticks, handles and the broker

for _name in ("upsert", "insert", "drain", "tick", "tock", "lpt", "replay", "subscribe"):
    VALUES[_name] = lambda i, s, *a, name=_name: getattr(i.engine.ticks, name)(*a)
for _name in ("publish", "subscribe", "subscribeFiltered", "unsubscribe", "eod", "list", "validateSeq", "validateSeqStrict"):
    VALUES[f".broker.{_name}"] = lambda i, s, *a, name=_name: getattr(i.engine.ticks.broker, re.sub("([A-Z])", lambda m: "_" + m[1].lower(), name))(*a)
for _name in ("list", "open", "close", "onDisconnected", "connect", "subscribing", "exists", "rotate", "fsync", "reply"):
    VALUES[f".handle.{_name}"] = lambda i, s, *a, name=_name: getattr(i.engine.ticks.handles, re.sub("([A-Z])", lambda m: "_" + m[1].lower(), name))(*a)


@value("replay_q", "sub_q")
def foreign(i, s, *a):
    raise ValueError("logs and sockets of other systems aren't read here")


# jobs

for _name in ("list", "add", "addAfter", "addAtTime", "get", "activate", "deactivate", "clear"):
    VALUES[f".job.{_name}"] = lambda i, s, *a, name=_name: getattr(i.engine.jobs, re.sub("([A-Z])", lambda m: "_" + m[1].lower(), name))(*a)


# system and logging

VALUES |= {
    ".os.sleep": lambda i, s, ms: time.sleep(ms / 1000), ".os.getenv": lambda i, s, n: os.environ.get(n, ""), ".os.setenv": lambda i, s, n, v: os.environ.__setitem__(n, v),
    ".os.glob": lambda i, s, p: from_columns(i.engine.spark, {"path": (found := sorted(glob.glob(p))), "size": [os.path.getsize(x) for x in found], "is_dir": [os.path.isdir(x) for x in found]}),
    ".os.seed": lambda i, s, n: i.engine.random.seed(n), ".os.pid": lambda i, s, *a: os.getpid(), ".os.version": lambda i, s, *a: __version__,
    ".os.syntax": lambda i, s, *a: Sym(i.engine.syntax), ".os.mem": lambda i, s, *a: i.engine.memory(),
}


@value(".os.system")
def system(i, s, *a):
    raise PermissionError("shell commands aren't run from queries")


for _name in ("info", "warn", "debug", "error"):
    VALUES[f".log.{_name}"] = lambda i, s, x, level=_name: getattr(log, "warning" if level == "warn" else level)(" ".join(map(str, x)) if isinstance(x, list) else str(x))
