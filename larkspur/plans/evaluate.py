"""The interpreter: syntax trees to values and DataFrame plans.

Inside a query, names of columns are expressions and built-ins build columns, so that a user's function expands into the
plan; outside, built-ins work on values of the driver: numbers, text, lists, dicts and frames.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import functions as F

from larkspur.functions.columns import COLUMN, in_order
from larkspur.lang.lexer import Sym
from larkspur.plans.expr import Context, Expr
from larkspur.plans.frame import Frame, from_columns, quoted
from larkspur.sources.partitioned import PartitionProblem, PartTable, conditions_name

MAX_DEPTH = 37


class EvalProblem(Exception):
    """An error of the language; raise gives it the raised value."""

    def __init__(self, message: Any):
        super().__init__(str(message))
        self.value = message


class NameProblem(EvalProblem):
    """An unknown name."""


class Return(Exception):
    def __init__(self, value: Any):
        self.value = value


@dataclass
class Builtin:
    name: str

    def __repr__(self) -> str:
        return self.name


@dataclass
class Function:
    """A user's function."""

    params: list[str]
    body: list[tuple]
    source: str

    def __repr__(self) -> str:
        return self.source


@dataclass
class Partial:
    """A function with some arguments given; MISSING marks the others."""

    fn: Any
    args: list[Any]

    def __repr__(self) -> str:
        return f"projection of {self.fn!r}"


MISSING = object()


@dataclass
class Scope:
    """Names of a call, and the columns of a query under evaluation."""

    names: dict[str, Any] | None = None
    columns: frozenset[str] = frozenset()
    depth: int = 0
    extra: dict[str, Any] = field(default_factory=dict)


def symbols(x: Any) -> list[str]:
    return [str(x)] if isinstance(x, str) else [str(v) for v in (x or [])]


def truthy(x: Any) -> bool:
    if x is None or isinstance(x, str):
        raise EvalProblem(f"{x!r} is neither true nor false")
    return bool(len(x)) if isinstance(x, (list, dict)) else bool(x)


class Interpreter:
    """Evaluates trees against an engine's variables, tables and value functions."""

    def __init__(self, engine):
        self.engine = engine

    def program(self, nodes, scope: Scope | None = None) -> Any:
        out = None
        for n in nodes:
            out = self.eval(n, scope or Scope())
        return out

    def eval(self, node: tuple, scope: Scope) -> Any:
        return getattr(self, "_" + node[0])(scope, *node[1:])

    # values

    def _value(self, scope, v):
        return list(v) if isinstance(v, list) else v

    def _missing(self, scope):
        return MISSING

    def _op(self, scope, name):
        return Builtin(name)

    def _group(self, scope, node):
        return self.eval(node, scope)

    def _column(self, scope, name):
        return Expr(lambda c: quoted(name), name)

    def _list(self, scope, items):
        return [self.eval(i, scope) for i in items]

    def _dict(self, scope, pairs):
        return {Sym(k if k else f"col{i:02d}"): self.eval(e, scope) for i, (k, e) in enumerate(pairs)}

    def _frame(self, scope, pairs):
        out = {}
        for i, (k, e) in enumerate(pairs):
            v = self.eval(e, scope)
            out[k or f"col{i:02d}"] = v
        return from_columns(self.engine.spark, out)

    def _function(self, scope, params, body, source):
        return Function(params, body, source)

    def _id(self, scope, name):
        if name in scope.columns:
            return Expr(lambda c: quoted(name), name)
        if name == "i" and scope.columns:
            return Expr(lambda c: F.row_number().over(c.ordered()) - 1, "i", win=True, virtual=True)
        if scope.names is not None and name in scope.names:
            return scope.names[name]
        if self.engine.has_var(name):
            return self.engine.get_var(name)
        if name in ("this.h", "this.user"):
            return self.engine.context.get(name)
        if name == "col" or name in COLUMN or name in self.engine.values:
            return Builtin(name)
        raise NameProblem(f"no name {name!r}")

    def _assign(self, scope, name, node):
        value = self.eval(node, scope)
        if scope.names is not None and not name.startswith("."):
            scope.names[name] = value
        else:
            self.engine.set_var(name, value)
        return value

    def _put(self, scope, target, keys, node):
        holder, value = self.eval(target, scope), self.eval(node, scope)
        if not isinstance(holder, dict):
            raise EvalProblem("only dicts take values by key")
        for k in keys:
            holder[self.eval(k, scope)] = value
        return value

    # control

    def _block(self, scope, nodes):
        out = None
        for n in nodes:
            out = self.eval(n, scope)
        return out

    def _if(self, scope, condition, then, other):
        return self._block(scope, then if truthy(self.eval(condition, scope)) else other)

    def _cond(self, scope, parts):
        if len(parts) >= 3:
            first = self.eval(parts[0], scope)
            if isinstance(first, Expr):
                rest = [self.eval(p, scope) for p in parts[1:]]
                return COLUMN["when"](first, rest[0], rest[1] if len(rest) == 2 else self._cond(scope, parts[2:]))
            return self.eval(parts[1], scope) if truthy(first) else self._cond(scope, parts[2:])
        if len(parts) == 2:
            return self.call(scope, Builtin("$"), [self.eval(p, scope) for p in parts])
        return self.eval(parts[0], scope) if parts else None

    def _while(self, scope, condition, body):
        while truthy(self.eval(condition, scope)):
            self._block(scope, body)

    def _try(self, scope, body, name, handler):
        try:
            return self._block(scope, body)
        except Return:
            raise
        except Exception as e:
            self._assign(scope, name, ("value", str(e)))
            return self._block(scope, handler)

    def _return(self, scope, node):
        raise Return(self.eval(node, scope))

    def _raise(self, scope, node):
        value = self.eval(node, scope)
        raise EvalProblem(value.strftime("%Y.%m.%d") if hasattr(value, "strftime") and not hasattr(value, "hour") else value)

    # calls

    def _binary(self, scope, op, a, b):
        x = self.eval(a, scope)
        if op in ("||", "&&", "??") and not isinstance(x, Expr):
            done = truthy(x) if op == "||" else not truthy(x) if op == "&&" else x is not None
            return x if done else self.eval(b, scope)
        if op == "fby":
            keys = self.eval(b, scope)
            return COLUMN["fby"](x, keys)
        return self.call(scope, Builtin(op), [x, self.eval(b, scope)])

    def _apply(self, scope, fn, arg):
        return self.call(scope, self.eval(fn, scope), [self.eval(arg, scope)])

    def _call(self, scope, fn, args):
        return self.call(scope, self.eval(fn, scope), [self.eval(a, scope) for a in args])

    def call(self, scope: Scope, fn: Any, args: list[Any]) -> Any:
        if any(a is MISSING for a in args) and not (isinstance(fn, (Builtin, Function)) and len(args) == 1):
            return Partial(fn, args)
        args = [] if len(args) == 1 and args[0] is MISSING else args
        if isinstance(fn, Partial):
            rest = iter(args)
            filled = [next(rest, MISSING) if a is MISSING else a for a in fn.args]
            return Partial(fn.fn, filled) if any(a is MISSING for a in filled) else self.call(scope, fn.fn, filled)
        if isinstance(fn, Function):
            return self._user(scope, fn, args)
        if isinstance(fn, Builtin):
            return self._builtin(scope, fn.name, args)
        if isinstance(fn, (str, Sym)) and args:
            return self.call(scope, self._id(Scope(), str(fn)), args)
        if callable(fn):
            return fn(*args)
        return functools.reduce(lambda x, k: self.call(scope, Builtin("@"), [x, k]), args, fn)

    def _user(self, scope: Scope, fn: Function, args: list[Any]) -> Any:
        if scope.depth >= MAX_DEPTH:
            raise EvalProblem("calls nest too deep")
        if len(args) > len(fn.params) or len(args) < len(fn.params) and self.engine.syntax == "infix":
            raise EvalProblem(f"expected {len(fn.params)} arguments, got {len(args)}")
        if len(args) < len(fn.params):
            return Partial(fn, args + [MISSING] * (len(fn.params) - len(args)))
        inner = Scope(dict(zip(fn.params, args, strict=True)), scope.columns, scope.depth + 1)
        try:
            return self._block(inner, fn.body)
        except Return as r:
            return r.value

    def _builtin(self, scope: Scope, name: str, args: list[Any]) -> Any:
        if any(isinstance(a, Expr) for a in args) or name == "col" or name == "lit" and scope.columns:
            if name == "col":
                return Expr(lambda c: quoted(str(args[0])), str(args[0]))
            if name not in COLUMN:
                raise EvalProblem(f"{name} has no column form")
            return COLUMN[name](*args)
        if name in self.engine.values:
            try:
                return self.engine.values[name](self, scope, *args)
            except NotImplementedError:
                pass
        if name not in COLUMN:
            raise EvalProblem(f"{name} doesn't take {', '.join(type(a).__name__ for a in args)}")
        return self.over_values(name, args)

    def over_values(self, name: str, args: list[Any]) -> Any:
        """A column function on values: its lists become the columns of a small frame."""
        data = [a for a in args if isinstance(a, list) and not (name in ("within", "in") and a is args[1])]
        columns = {f"c{k}": a for k, a in enumerate(args) if any(a is d for d in data)} or {"c0": args[-1]}
        frame = from_columns(self.engine.spark, columns)
        at = [k for k in range(len(args)) if f"c{k}" in columns] if data else [len(args) - 1]
        exprs = [Expr(lambda c, n=f"c{k}" if data else "c0": quoted(n), f"c{k}") if k in at else a for k, a in enumerate(args)]
        made = COLUMN[name](*exprs)
        out = self.select(frame, [("v", made)], [])
        rows = [r["v"] for r in out.sorted().collect()]
        return rows[0] if made.agg or not data else rows

    # queries

    def _query(self, scope, kind, items, by, source, conditions, limit):
        table = self.eval(source, scope)
        if isinstance(table, str):
            table = self.engine.get_var(str(table))
        if isinstance(table, PartTable):
            if table.kind != "single" and not any(conditions_name(c, table.kind) for c in conditions):
                raise PartitionProblem(f"{table.name} needs a condition on {table.kind}")
            table = table.frame
        if not isinstance(table, Frame):
            raise EvalProblem("a query needs a frame")
        inner = Scope(scope.names, frozenset(table.columns), scope.depth, scope.extra)
        make = lambda clauses: [(n, self._named(e, inner)) for n, e in clauses]
        n = self.eval(limit, scope) if limit is not None else None
        wheres = [self.eval(c, inner) for c in conditions]
        if kind == "exec":
            raise EvalProblem("exec isn't supported")
        if kind == "delete":
            if items and wheres:
                raise EvalProblem("delete takes columns or conditions, not both")
            return self.delete(table, wheres, [self._column_name(e, inner) for _, e in items])
        if kind == "update":
            return self.update(table, make(items), make(by), wheres)
        return self.limit(self.select(self.where(table, wheres), make(items), make(by)), n)

    def _column_name(self, node, scope) -> str:
        v = self.eval(node, scope)
        return v.name if isinstance(v, Expr) else str(v)

    def _named(self, node, scope):
        return self.eval(node, scope)

    @staticmethod
    def names(clauses: list[tuple[str | None, Any]], taken: list[str] | None = None) -> list[str]:
        """Aliases, or the leftmost column's name; repeated ones are numbered."""
        out = list(taken or [])
        for k, (alias, e) in enumerate(clauses):
            name = alias or getattr(e, "name", None) or ("i" if getattr(e, "virtual", False) else f"col{k:02d}")
            base, m = name, 1
            while name in out:
                name, m = f"{base}_{m}", m + 1
            out.append(name)
        return out[len(taken or []) :]

    @staticmethod
    def where(frame: Frame, conditions: list[Any]) -> Frame:
        if not conditions:
            return frame
        c = Context(frame.data, list(frame.order))
        tests = [c.plain(e) for e in conditions]
        return Frame(c.df.where(functools.reduce(lambda a, b: a & b, tests)), c.order_names).tidy()

    def select(self, frame: Frame, items: list[tuple[str | None, Any]], by: list[tuple[str | None, Any]]) -> Frame:
        items = [(n, e if isinstance(e, Expr) else Expr(lambda c, e=e: c.plain(e), None)) for n, e in items]
        if by:
            return self._grouped(frame, items, by)
        if not items:
            return frame
        names = self.names(items)
        if all(e.agg for _, e in items):
            c = Context(frame.data, list(frame.order), group=True)
            columns = [e.build(c).alias(n) for n, (_, e) in zip(names, items, strict=True)]
            return Frame(c.df.agg(*columns))
        c = Context(frame.data, list(frame.order))
        columns = [e.build(c).alias(n) for n, (_, e) in zip(names, items, strict=True)]
        hidden = [quoted(o) for o in c.order_names if o not in names]
        kept = Frame(c.df.select(*columns, *(h.alias(o if o.startswith("__") else f"__{o}") for h, o in zip(hidden, [o for o in c.order_names if o not in names], strict=True))), [o if o in names or o.startswith("__") else f"__{o}" for o in c.order_names])
        return kept

    def _grouped(self, frame: Frame, items, by) -> Frame:
        by = [(n, e if isinstance(e, Expr) else Expr(lambda c, e=e: c.plain(e), None)) for n, e in by]
        key_names = self.names(by)
        c = Context(frame.data, list(frame.order), group=True)
        keys = [c.plain(e) for _, e in by]
        c.keys = keys
        ordered = bool(frame.order)
        if not items:
            place = c.position()
            rest = [n for n in frame.columns if n not in key_names]
            last = c.df.groupBy(*(k.alias(n) for k, n in zip(keys, key_names, strict=True))).agg(F.max_by(F.struct(*map(quoted, rest)), place).alias("__last"), F.min(place).alias("__row"))
            return Frame(last.select(*map(quoted, key_names), *(F.col("__last")[n].alias(n) for n in rest), "__row"), ["__row"])
        names = self.names(items, key_names)
        columns = [(e.build(c) if e.agg else in_order(c, c.plain(e))).alias(n) for n, (_, e) in zip(names, items, strict=True)]
        extra = [F.min(c.position()).alias("__row")] if ordered else []
        out = c.df.groupBy(*(k.alias(n) for k, n in zip(keys, key_names, strict=True))).agg(*columns, *extra)
        return Frame(out, ["__row"] if ordered else [])

    def update(self, frame: Frame, items, by, conditions) -> Frame:
        """New or replaced columns, over groups if there are keys; where a condition fails the old value stays."""
        c = Context(frame.data, list(frame.order))
        c.keys = [c.plain(e) for _, e in by]
        test = functools.reduce(lambda a, b: a & b, [c.plain(e) for e in conditions]) if conditions else None
        if test is not None:
            test = c.stage(test)
        names = self.names([(n, e) for n, e in items])
        made = {}
        for name, (_, e) in zip(names, items, strict=True):
            value = c.plain(e)
            if test is not None:
                old = quoted(name) if name in frame.columns else F.lit(None)
                value = F.when(test, value).otherwise(old)
            made[name] = c.stage(value)
        order = list(c.order_names)
        df = c.df
        for o in [o for o in order if o in made]:  # the old values keep ordering the rows
            df = df.withColumn(f"__{o}", quoted(o))
            order[order.index(o)] = f"__{o}"
        return Frame(df.withColumns(made), order).tidy()

    @staticmethod
    def delete(frame: Frame, conditions, columns: list[str]) -> Frame:
        """Rows that meet any condition go (and rows for which one is null), or the named columns, or all rows."""
        if columns:
            if missing := [n for n in columns if n not in frame.columns]:
                raise EvalProblem(f"no column {missing[0]!r}")
            return Frame(frame.data.drop(*columns), [o for o in frame.order if o not in columns])
        if not conditions:
            return Frame(frame.data.where(F.lit(False)), frame.order)
        c = Context(frame.data, list(frame.order))
        tests = [~c.plain(e) for e in conditions]
        return Frame(c.df.where(functools.reduce(lambda a, b: a & b, tests)), c.order_names).tidy()

    @staticmethod
    def limit(frame: Frame, n: int | None) -> Frame:
        """The first n rows, the last ones for a negative n, none for 0."""
        if n is None:
            return frame
        if n == 0:
            return Frame(frame.data.where(F.lit(False)), frame.order)
        if n > 0 and not frame.order:
            return Frame(frame.data.limit(n))
        frame = frame.ordered()
        keys = [quoted(o).asc() if n > 0 else quoted(o).desc() for o in frame.order]
        return Frame(frame.data.orderBy(*keys).limit(abs(n)), frame.order)


def frame_of(x: Any, spark) -> Frame:
    if isinstance(x, PartTable):
        return x.frame
    if isinstance(x, dict):
        return from_columns(spark, {str(k): v for k, v in x.items()})
    if isinstance(x, list):
        return from_columns(spark, {"col00": x})
    if not isinstance(x, Frame):
        raise EvalProblem(f"expected a frame, got {type(x).__name__}")
    return x
