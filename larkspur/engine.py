"""The host-language API: an engine on a SparkSession."""

from __future__ import annotations

import datetime as dt
import os
import random
import threading
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from larkspur.functions.values import VALUES, syms
from larkspur.lang import parser
from larkspur.plans.evaluate import Builtin, Interpreter, Scope
from larkspur.plans.expr import Expr, by_row
from larkspur.plans.frame import Frame, from_columns
from larkspur.sources import partitioned
from larkspur.streaming.jobs import Jobs
from larkspur.streaming.ticks import Ticks

SETTINGS = {"spark.sql.session.timeZone": "UTC", "spark.sql.sources.partitionOverwriteMode": "dynamic", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
_RAISE = object()
HOOKS = ("pre_eval", "post_eval", "conn_open", "conn_close", "bad_msg")


class Engine:
    """Evaluates source text in one of two syntaxes, `infix` or `terse`, and holds variables, tables, ticks and jobs."""

    def __init__(self, spark: SparkSession, syntax: str = "infix", job_interval: float = 0.05, settings: dict | None = None):
        self.spark, self.syntax, self.vars, self.tables = spark, syntax, {}, {}
        for k, v in (SETTINGS | (settings or {})).items():
            spark.conf.set(k, v)
        self.values, self.random, self.context, self.display = dict(VALUES), random.Random(), {}, (20, 20)
        self.hooks: dict[str, list[Callable]] = {h: [] for h in HOOKS}
        self.batches: dict[int, int] = {}
        self.sources: dict[int, tuple[str, str]] = {}
        self.imported: set[str] = set()
        self.timeout_ms, self.queue_max, self.evals = 0, 0, 0
        self.interpreter, self.ticks, self.jobs = Interpreter(self), Ticks(self), Jobs(self, job_interval)

    # evaluation

    def eval(self, source: Any, *args: Any) -> Any:
        """The value of a program's last statement; frames stay lazy. A list is a call, a name's value a symbol's."""
        for hook in self.hooks["pre_eval"]:
            changed = hook(source)
            source = source if changed is None else changed
        timer = None
        if self.timeout_ms:
            self.spark.sparkContext.setJobGroup("larkspur-eval", "eval", True)
            timer = threading.Timer(self.timeout_ms / 1000, lambda: self.spark.sparkContext.cancelJobGroup("larkspur-eval"))
            timer.start()
        try:
            if isinstance(source, str):
                out = self.interpreter.program(parser.parse(source, self.syntax))
            else:
                out = self.call(source[0], *source[1:])
        finally:
            if timer:
                timer.cancel()
        self.evals += 1
        for hook in self.hooks["post_eval"]:
            hook(source, out)
        return out

    def call(self, fn: Any, *args: Any) -> Any:
        """Calls a function by value or name."""
        target = self.interpreter._id(Scope(), fn) if isinstance(fn, str) else fn
        return self.interpreter.call(Scope(), target, list(args) or [])

    fn_call = call

    def sql_frame(self, source: str) -> DataFrame:
        """A query's result as a DataFrame."""
        return self.eval(source).df

    def query_plan(self, source: str, mode: str = "formatted") -> str:
        """The plan of a query, not run."""
        df = self.eval(source).df
        return df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))

    def register(self, name: str, fn: Callable) -> None:
        """A Python function of columns for queries, or of values outside them."""

        def run(i, s, *a):
            return by_row(fn, *a) if any(isinstance(x, Expr) for x in a) else fn(*a)

        self.set_var(name, lambda *a: run(None, None, *a))

    # variables

    def set_var(self, name: str, value: Any) -> Any:
        """DataFrames become frames, and frames temporary views too."""
        value = Frame(value) if isinstance(value, DataFrame) else value
        self.vars[name] = value
        if isinstance(value, Frame) and name.isidentifier():
            value.df.createOrReplaceTempView(name)
        return value

    def set_table(self, name: str, df: DataFrame, order: list[str] | None = None) -> Frame:
        """A DataFrame with the columns that order its rows."""
        return self.set_var(name, Frame(df, order))

    def get_var(self, name: str, default: Any = _RAISE) -> Any:
        if name in self.vars:
            return self.vars[name]
        if name in self.tables:
            return self.tables[name]
        if default is _RAISE:
            raise KeyError(name)
        return default

    def has_var(self, name: str) -> bool:
        return name in self.vars or name in self.tables

    def del_var(self, name: str) -> Any:
        if name.isidentifier():
            self.spark.catalog.dropTempView(name)
        return self.vars.pop(name, None)

    def list_vars(self, prefix: str = "") -> Frame:
        names = sorted(n for n in [*self.vars, *self.tables] if n.startswith(prefix))
        return from_columns(self.spark, {"name": names, "type": [self._type(self.get_var(n)) for n in names]})

    def get_displayed_vars(self) -> dict[str, str]:
        return {n: self._type(v) for n, v in sorted(self.vars.items())}

    def _type(self, v: Any) -> str:
        return str(VALUES["type"](self.interpreter, Scope(), v))

    def table_names(self, prefix: str = "") -> list[str]:
        return sorted(n for n in [*self.vars, *self.tables] if n.startswith(prefix) and isinstance(self.get_var(n), (Frame, partitioned.PartTable)))

    def text_of(self, value: Any) -> str:
        return value.df._show_string(self.display[0], 0, False) if isinstance(value, Frame) else repr(value)

    def show(self, value: Any) -> None:
        print(self.text_of(value))

    # hooks

    def _hook(self, kind: str, fn: Callable | None) -> None:
        self.hooks[kind] = [fn] if fn else []

    def __getattr__(self, name: str):
        """set_, get_ and clear_ for each hook: pre_eval, post_eval, on_conn_open, on_conn_close, on_bad_msg."""
        verb, _, rest = name.partition("_")
        kind = rest.removesuffix("_hook").removeprefix("on_")
        if verb in ("set", "get", "clear") and rest.endswith("_hook") and kind in HOOKS:
            return {"set": lambda fn: self._hook(kind, fn), "clear": lambda: self._hook(kind, None), "get": lambda: next(iter(self.hooks[kind]), None)}[verb]
        raise AttributeError(name)

    # queries on data

    def _clauses(self, items: Any) -> list[tuple[str | None, Any]]:
        if items is None:
            return []
        pairs = list(items.items()) if isinstance(items, dict) else [(None, x) for x in (items if isinstance(items, list) else [items])]
        return [(str(k) if k else None, self._expr(v)) for k, v in pairs]

    def _expr(self, v: Any) -> Any:
        """A symbol is a column, a list a call, anything else itself."""
        from pyspark.sql import functions as F

        if isinstance(v, str):
            return Expr(lambda c: F.col(f"`{v}`"), str(v))
        if isinstance(v, list) and v and isinstance(v[0], (Builtin, str)):
            head = v[0] if isinstance(v[0], Builtin) else Builtin(str(v[0]))
            return self.interpreter.call(Scope(columns=frozenset(["*"])), head, [self._expr(x) if isinstance(x, list) or type(x).__name__ == "Sym" else x for x in v[1:]])
        return v

    def _table(self, table: Any, partitions: Any = None) -> Frame:
        from pyspark.sql import functions as F

        value = self.get_var(str(table)) if isinstance(table, str) else table
        if not isinstance(value, partitioned.PartTable):
            return value
        if value.kind == "single":
            return value.frame
        if partitions is None:
            raise partitioned.PartitionProblem(f"{value.name} needs partitions")
        key = F.col(value.kind)
        if isinstance(partitions, list) and len(partitions) == 2:
            return Frame(value.data.where(key.between(*map(F.lit, partitions))))
        return Frame(value.data.where(key.isin(partitions if isinstance(partitions, list) else [partitions])))

    def functional_select(self, table, partitions=None, where=None, group=None, operations=None, limit=None) -> Frame:
        i = self.interpreter
        frame = i.where(self._table(table, partitions), [e for _, e in self._clauses(where)])
        return i.limit(i.select(frame, self._clauses(operations), self._clauses(group)), limit)

    def functional_update(self, table, where=None, group=None, operations=None) -> Frame:
        return self.interpreter.update(self._table(table), self._clauses(operations), self._clauses(group), [e for _, e in self._clauses(where)])

    def functional_delete(self, table, where=None, columns=None) -> Frame:
        return self.interpreter.delete(self._table(table), [e for _, e in self._clauses(where)], syms(columns))

    # tables on disk

    def write_partitioned_df(self, df: Any, root: str, table: str, partition: Any = None, sort_columns: list[str] | None = None, rechunk: bool = False, overwrite: bool = False) -> int:
        return self.write_partitioned_df_custom(df, root, table, partition, sort_columns, rechunk, overwrite)

    def write_partitioned_df_custom(self, df: Any, root: str, table: str, partition: Any = None, sort_columns: list[str] | None = None, rechunk: bool = False, overwrite: bool = False, compression: str = "zstd") -> int:
        frame = df if isinstance(df, Frame) else Frame(df)
        return partitioned.write(self.spark, root, partition, table, frame, sort_columns, rechunk, overwrite, compression)

    def load_partitioned_df(self, root: str) -> list[str]:
        found = partitioned.discover(self.spark, root)
        self.tables |= found
        return sorted(found)

    def clear_partitioned_df(self) -> None:
        self.tables.clear()

    def table_count(self) -> int:
        return len(self.tables)

    # sources

    def import_source_path(self, path: str, name: str | None = None) -> Any:
        """Evaluates a source file once; relative paths are looked up in LARKSPUR_PATH too. The suffix .terse tells the syntax."""
        places = [path, *(os.path.join(p, path) for p in os.environ.get("LARKSPUR_PATH", "").split(os.pathsep) if p)]
        full = next((os.path.realpath(p) for p in places if os.path.isfile(p)), None)
        if full is None:
            raise FileNotFoundError(path)
        if full in self.imported:
            return None
        self.imported.add(full)
        with open(full) as f:
            text = f.read()
        self.set_source(name or full, text)
        return self.interpreter.program(parser.parse(text, "terse" if full.endswith(".terse") else "infix"))

    def set_source(self, path: str, text: str) -> int:
        self.sources[len(self.sources)] = (path, text)
        return len(self.sources) - 1

    def get_source(self, index: int) -> tuple[str, str]:
        return self.sources[index]

    @staticmethod
    def parse_cache_len() -> int:
        return parser.parse.cache_info().currsize

    # ticks

    def init_tick(self, schemas: dict[str, DataFrame], log: str | None = None) -> int:
        self.ticks.schemas = {k: Frame(v) if isinstance(v, DataFrame) else v for k, v in schemas.items()}
        return self.ticks.start_log(log) if log else 0

    load_tick = init_tick

    def roll_tick_log(self, log: str) -> int:
        return self.ticks.start_log(log)

    def publish(self, table: str, data: Any, tick: Any = 0) -> int:
        return self.ticks.lpt(table, Frame(data) if isinstance(data, DataFrame) else data, tick)

    def eod(self, message: Any = None) -> int:
        return self.ticks.broker.eod(message)

    def subscribe(self, topics: Any, fn: Callable | None = None, filters: dict | None = None) -> int:
        """Without a function, batches go to the frames named like the topics."""
        return self.ticks.subscribe(topics, fn or (lambda m: self.ticks.upsert(m[1], m[2]) if m[0] == "upd" else None), filters)

    load_sub = subscribe

    def upsert(self, name: str, value: Any) -> int:
        return self.ticks.upsert(name, value)

    def insert(self, name: str, by: Any, value: Any) -> int:
        return self.ticks.insert(name, by, value)

    def drain(self, name: str) -> DataFrame | None:
        out = self.ticks.drain(name)
        return out.df if out is not None else None

    def tick(self, step: int = 1, index: int = 0) -> int:
        return self.ticks.tick(index, step)

    def get_tick_count(self, index: int = 0) -> int:
        return self.ticks.counts[index]

    def set_tick_count(self, value: int, index: int = 0) -> int:
        return self.ticks.tock(index, value)

    def open_handle(self, uri: Any) -> int:
        n = self.ticks.handles.open(uri)
        for hook in self.hooks["conn_open"]:
            hook(n)
        return n

    def list_handle(self) -> Frame:
        return self.ticks.handles.list()

    def fsync_handle(self, n: int) -> bool:
        return self.ticks.handles.fsync(n)

    def sync(self, n: int, message: Any) -> Any:
        return self.ticks.handles.reply(n, message)

    async_ = sync

    # jobs and the session

    def add_at_time(self, fn: Any, start: dt.datetime, description: str = "") -> int:
        if start.tzinfo is None:
            raise ValueError("a start needs a time zone")
        return self.jobs.add_at_time(fn, start.astimezone(dt.UTC).replace(tzinfo=None), description)

    def set_jobs_deactivate_on_error(self, on: bool) -> None:
        self.jobs.deactivate_on_error = on

    def jobs_deactivate_on_error(self) -> bool:
        return self.jobs.deactivate_on_error

    def set_eval_timeout_ms(self, ms: int) -> None:
        self.timeout_ms = ms

    def eval_timeout_ms(self) -> int:
        return self.timeout_ms

    def set_subscriber_queue_max(self, n: int) -> None:
        """Files a following stream takes at a time at most."""
        self.queue_max = n

    def start_tcp_listener(self, *_: Any):
        raise NotImplementedError("remote sessions use Spark Connect")

    stop_tcp_listener = start_tcp_listener

    @staticmethod
    def is_lazy_mode() -> bool:
        return True

    def is_infix_syntax(self) -> bool:
        return self.syntax == "infix"

    def memory(self) -> dict[str, int]:
        run = self.spark._jvm.java.lang.Runtime.getRuntime()
        return {"used": run.totalMemory() - run.freeMemory(), "total": run.totalMemory(), "max": run.maxMemory()}

    def stats(self) -> dict[str, Any]:
        tracker = self.spark.sparkContext.statusTracker()
        return {"evals": self.evals, "vars": len(self.vars), "tables": len(self.tables), "jobs": len(self.jobs.held), "active_spark_jobs": len(tracker.getActiveJobsIds()), "parse_cache": self.parse_cache_len()}

    def shutdown(self) -> None:
        """Stops streams and jobs; the session is the caller's."""
        self.jobs.stop()
        for q in self.spark.streams.active:
            q.stop()
