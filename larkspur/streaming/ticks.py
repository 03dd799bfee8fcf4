"""Publish and subscribe: batches are appended to a log folder, passed to subscribers, and replayed from the log.

A message is one Parquet folder `log/seq=N/table=T`, written before anyone sees it. Subscribers in this session get
DataFrames; others follow the log with readStream. Rows are filtered for each subscriber by one column's values.
"""

from __future__ import annotations

import datetime as dt
import re
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators import reshape
from larkspur.plans.frame import Frame, from_columns, quoted
from larkspur.session import shared_folder
from larkspur.sources.partitioned import children

SLOTS = 1024
#: A growing frame is written to the checkpoint folder once in so many batches.
COMPACT = 16


class LogProblem(ValueError):
    """A log folder that isn't whole."""


@dataclass
class Subscriber:
    handle: int
    topic: str
    column: str | None = None
    values: list[str] = field(default_factory=list)

    def wanted(self, df: DataFrame) -> DataFrame:
        """The rows it asked for; all if there is no such column."""
        if self.column is None or self.column not in df.columns:
            return df
        return df.where(quoted(self.column).cast("string").isin(self.values))


@dataclass
class Handle:
    number: int
    uri: str
    target: Any = None
    open: bool = True
    callback: Any = None
    query: Any = None


class Handles:
    """Numbered sources and sinks: file:// log folders and functions of this session."""

    def __init__(self, ticks: Ticks):
        self.ticks, self.held, self.counter = ticks, {}, 0

    def open(self, uri: Any) -> int:
        if isinstance(uri, str) and "://" in uri and not str(uri).startswith("file://"):
            raise ValueError("only file:// handles are opened; remote sessions use Spark Connect")
        self.counter += 1
        self.held[self.counter] = Handle(self.counter, str(uri), uri if callable(uri) else None)
        return self.counter

    def of(self, n: int) -> Handle:
        if n not in self.held:
            raise KeyError(f"no handle {n}")
        return self.held[n]

    def close(self, n: int) -> bool:
        h = self.of(n)
        h.open = False
        if h.query is not None:
            h.query.stop()
        if h.callback is not None:
            self.ticks.engine.call(h.callback, n)
        for hook in self.ticks.engine.hooks["conn_close"]:
            hook(n)
        del self.held[n]
        return True

    def connect(self, n: int) -> bool:
        self.of(n).open = True
        return True

    def on_disconnected(self, n: int, callback: Any) -> None:
        self.of(n).callback = callback

    def subscribing(self, n: int) -> None:
        """Follows the handle's log from now on, passing batches to `upd`."""
        h = self.of(n)
        h.query = self.ticks.follow(h.uri.removeprefix("file://"), lambda t, df: self.ticks.engine.call("upd", t, df))

    def exists(self, n: int) -> bool:
        return n in self.held

    def rotate(self, n: int, uri: str) -> None:
        self.of(n).uri = str(uri)
        self.ticks.counts[0] = 0

    def fsync(self, n: int) -> bool:
        """Batches are committed as they are written; nothing is left to flush."""
        return self.of(n).open

    def reply(self, n: int, message: Any) -> Any:
        h = self.of(n)
        return h.target(message) if h.target else None

    def list(self) -> Frame:
        rows = list(self.held.values())
        return from_columns(self.ticks.engine.spark, {"handle": [h.number for h in rows], "uri": [h.uri for h in rows], "open": [h.open for h in rows]})


class Broker:
    """Topics and who takes them."""

    def __init__(self, ticks: Ticks):
        self.ticks, self.subscribers = ticks, []

    def subscribe(self, handle: int, topics: Any) -> None:
        for t in [topics] if isinstance(topics, str) else topics:
            self.unsubscribe(handle, t)
            self.subscribers.append(Subscriber(handle, str(t)))

    def subscribe_filtered(self, handle: int, topic: str, column: str, values: list) -> None:
        self.unsubscribe(handle, topic)
        self.subscribers.append(Subscriber(handle, str(topic), str(column), [str(v) for v in (values if isinstance(values, list) else [values])]))

    def unsubscribe(self, handle: int, topics: Any) -> None:
        gone = {str(t) for t in ([topics] if isinstance(topics, str) else topics)}
        self.subscribers = [s for s in self.subscribers if s.handle != handle or s.topic not in gone]

    def publish(self, upd: str, table: str, message: Any) -> int:
        """Passes a frame on; returns to how many. Subscribers with one filter share one plan."""
        df = message.df if isinstance(message, Frame) else message
        plans: dict[tuple, DataFrame] = {}
        mine = [s for s in self.subscribers if s.topic == str(table)]
        for s in mine:
            key = (s.column, tuple(s.values))
            if key not in plans:
                plans[key] = s.wanted(df)
            self.ticks.handles.reply(s.handle, (str(upd), str(table), Frame(plans[key])))
        return len(mine)

    def eod(self, message: Any) -> int:
        seen = {s.handle for s in self.subscribers}
        for h in seen:
            self.ticks.handles.reply(h, ("eod", message))
        return len(seen)

    def list(self) -> Frame:
        return from_columns(self.ticks.engine.spark, {"topic": [s.topic for s in self.subscribers], "handle": [s.handle for s in self.subscribers], "column": [s.column for s in self.subscribers]})

    def validate_seq(self, path: str, must_read: bool = False) -> int:
        """How many messages of a log are whole, from the first on; a torn last one isn't counted."""
        n = 0
        for seq, whole in self.ticks.messages(path):
            if not whole or seq != n:
                break
            n += 1
        return n

    def validate_seq_strict(self, path: str, must_read: bool = False) -> int:
        found = self.ticks.messages(path)
        if (n := self.validate_seq(path)) != len(found):
            raise LogProblem(f"message {n} of {path} is torn or missing")
        return n


class Ticks:
    """Named frames that grow, counters, the log, and the broker."""

    def __init__(self, engine):
        self.engine, self.counts, self.lock = engine, [0] * SLOTS, threading.RLock()
        self.handles, self.broker, self.log, self.schemas = Handles(self), Broker(self), None, {}

    # growing frames

    def upsert(self, name: str, value: Any) -> int:
        """Appends rows, a frame or one row as a list; the first call makes the frame. Returns the rows given."""
        with self.lock:
            name, have = str(name), self.engine.get_var(str(name), None)
            new = self._rows(value, have)
            self.engine.set_var(name, self._append(have, new))
            return new.data.count()

    def _rows(self, value: Any, have: Frame | None) -> Frame:
        if isinstance(value, Frame):
            return value
        if isinstance(value, DataFrame):
            return Frame(value)
        names = have.columns if have else [f"col{i:02d}" for i in range(len(value))]
        return from_columns(self.engine.spark, dict(zip(names, value, strict=True)))

    def _append(self, have: Frame | None, new: Frame) -> Frame:
        batch = 0 if have is None else self.engine.batches.get(id(have), 0) + 1
        new = new.ordered()
        rows = new.data.orderBy(*map(quoted, new.order)).select(*map(quoted, new.columns), F.struct(F.lit(batch).cast("long").alias("b"), F.monotonically_increasing_id().alias("m")).alias("__row"))
        if have is not None:
            if have.order != ["__row"] or "struct" not in dict(have.data.dtypes)["__row"]:
                old = have.ordered()
                have = Frame(old.data.orderBy(*map(quoted, old.order)).select(*map(quoted, old.columns), F.struct(F.lit(-1).cast("long").alias("b"), F.monotonically_increasing_id().alias("m")).alias("__row")), ["__row"])
            rows = have.data.unionByName(rows)
        if batch % COMPACT == COMPACT - 1:  # or the plan would grow with every batch
            shared_folder(self.engine.spark)
            rows = rows.checkpoint()
        out = Frame(rows, ["__row"])
        self.engine.batches[id(out)] = batch
        return out

    def insert(self, name: str, by: Any, value: Any) -> int:
        """Appends, then keeps the last row of each key."""
        with self.lock:
            n = self.upsert(name, value)
            have, keys = self.engine.get_var(str(name)), [by] if isinstance(by, str) else by
            last = have.data.groupBy(*map(quoted, keys)).agg(F.max_by(F.struct("*"), "__row").alias("z")).select("z.*")
            out = Frame(last, ["__row"])
            self.engine.batches[id(out)] = self.engine.batches.get(id(have), 0)
            self.engine.set_var(str(name), out)
            return n

    def drain(self, name: str) -> Frame | None:
        """What a name has gathered, and an empty frame in its place."""
        with self.lock:
            have = self.engine.get_var(str(name), None)
            if have is None:
                raise KeyError(f"no frame {name}")
            if have is not None:
                self.engine.set_var(str(name), Frame(have.data.where(F.lit(False)), have.order))
            return have

    # counters

    def tick(self, index: Any, step: int | None = None) -> int:
        """Adds to a counter and returns it; with one argument, to counter 0."""
        index, step = (0, index) if step is None else (index, step)
        with self.lock:
            self.counts[int(index or 0)] += step
            return self.counts[int(index or 0)]

    def tock(self, index: int, value: int) -> int:
        with self.lock:
            self.counts[index] = value
            return value

    # the log

    def start_log(self, path: str) -> int:
        self.log = str(path).removeprefix("file://")
        self.counts[0] = self.broker.validate_seq(self.log)
        return self.counts[0]

    def lpt(self, table: str, data: Any, tick: Any = 0) -> int:
        """Log, publish, tick as one. A column name as tick stamps each row with its place in the stream."""
        with self.lock:
            frame = data if isinstance(data, Frame) else self._rows(data, self.schemas.get(str(table)))
            n = self.counts[0]
            if isinstance(tick, str):
                frame = frame.ordered()
                base = self.counts[1]
                rows = reshape.indexed(frame, "__tick").withColumn(tick, F.col("__tick") + F.lit(base)).drop("__tick")
                self.counts[1] += rows.count()
                frame = Frame(rows, frame.order)
            if self.log:
                frame.sorted().withColumn("__at", F.lit(time.time())).write.mode("overwrite").parquet(f"{self.log}/seq={n:012d}/table={table}")
            self.broker.publish("upd", str(table), frame)
            return self.tick(0 if isinstance(tick, str) else int(tick), 1)

    def messages(self, path: str) -> list[tuple[int, bool]]:
        """(number, whole) of a log's messages; a folder without its commit mark is torn."""
        spark, path = self.engine.spark, str(path).removeprefix("file://")
        out = []
        for name, _, _ in children(spark, path):
            if m := re.fullmatch(r"seq=(\d+)", name):
                tables = children(spark, f"{path}/{name}")
                out.append((int(m[1]), bool(tables) and all(any(x[0] == "_SUCCESS" for x in children(spark, f"{path}/{name}/{t}")) for t, _, _ in tables)))
        return sorted(out)

    def replay(self, path: str, start: Any = 0, end: int | None = None, tables: Any = None, evaluate: bool = True, handle: Any = None) -> list:
        """Messages [start, end) of a log, or from a time on, of the named tables: passed to `upd`, or returned."""
        spark, path = self.engine.spark, str(path).removeprefix("file://")
        want, out = {str(t) for t in ([tables] if isinstance(tables, str) else tables or [])}, []
        for n, whole in self.messages(path):
            if not whole:
                for hook in self.engine.hooks["bad_msg"]:
                    hook(path, n)
                continue
            if not isinstance(start, dt.datetime) and n < start or end is not None and n >= end:
                continue
            for t, _, _ in children(spark, f"{path}/seq={n:012d}"):
                table = t.removeprefix("table=")
                if want and table not in want:
                    continue
                df = spark.read.parquet(f"{path}/seq={n:012d}/{t}")
                if isinstance(start, dt.datetime) and (df.agg(F.max("__at")).first()[0] or 0) < start.replace(tzinfo=dt.UTC).timestamp():
                    continue
                message = (table, Frame(df.drop("__at")))
                out.append(self.engine.call("upd", *message) if evaluate else message)
        return len(out) if evaluate else out

    def follow(self, path: str, fn: Callable[[str, DataFrame], None], tables: list[str] | None = None, filters: dict[str, tuple[str, list]] | None = None, checkpoint: str | None = None, once: bool = False):
        """Structured Streaming over a log folder: fn(table, batch) for every micro-batch, at least once with a checkpoint.

        Tables of one schema may share a log; each query follows one. Returns the started queries.
        """
        spark, path, out = self.engine.spark, str(path).removeprefix("file://"), []
        names = tables or sorted({t.removeprefix("table=") for s, _, _ in children(spark, path) for t, _, _ in children(spark, f"{path}/{s}")})
        for name in names:
            known = spark.read.option("basePath", path).parquet(f"{path}/seq=*/table={name}")
            reader = spark.readStream.schema(known.schema).option("basePath", path)
            if self.engine.queue_max:
                reader = reader.option("maxFilesPerTrigger", self.engine.queue_max)
            stream = reader.parquet(f"{path}/seq=*/table={name}").drop("__at", "seq", "table")
            if filters and name in filters:
                column, values = filters[name]
                stream = Subscriber(0, name, column, [str(v) for v in values]).wanted(stream)
            writer = stream.writeStream.foreachBatch(lambda df, n, name=name: fn(name, df))
            writer = writer.option("checkpointLocation", f"{checkpoint}/{name}") if checkpoint else writer
            out.append((writer.trigger(availableNow=True) if once else writer).start())
        return out

    def subscribe(self, topics: Any, fn: Any, filters: dict | None = None) -> int:
        """Takes topics in this session; fn gets (upd, table, frame)."""
        n = self.handles.open(fn)
        for t in [topics] if isinstance(topics, str) else topics:
            if filters and t in filters:
                self.broker.subscribe_filtered(n, t, *filters[t])
            else:
                self.broker.subscribe(n, t)
        return n


def last_by_key(stream: DataFrame, keys: list[str], order: str, spark, target: str, checkpoint: str):
    """A streaming sink that keeps the latest row of each key in a Parquet folder; replays of a batch change nothing."""

    def upsert(batch: DataFrame, number: int) -> None:
        have = spark.read.parquet(f"{target}/v={number - 1}") if number else None
        rows = batch if have is None else have.unionByName(batch)
        last = rows.groupBy(*map(quoted, keys)).agg(F.max_by(F.struct("*"), order).alias("z")).select("z.*")
        last.write.mode("overwrite").parquet(f"{target}/v={number}")

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)


def windowed_counts(stream: DataFrame, time_column: str, length: str, late: str, by: list[str], slide: str | None = None, session: bool = False) -> DataFrame:
    """Rows by event-time window and keys, late rows admitted up to a watermark. With `session` a window lasts until no row
    came for that length."""
    window = F.session_window(time_column, length).alias("window") if session else F.window(time_column, length, slide) if slide else F.window(time_column, length)
    return stream.withWatermark(time_column, late).groupBy(window, *map(quoted, by)).agg(F.count(F.lit(1)).alias("n"))
