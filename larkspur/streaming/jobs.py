"""Jobs: functions called at times or intervals by a thread of the driver."""

from __future__ import annotations

import datetime as dt
import re
import threading
from dataclasses import dataclass
from typing import Any

from larkspur.plans.frame import Frame, from_columns


@dataclass
class Job:
    id: int
    fn: Any
    start: dt.datetime
    end: dt.datetime | None
    interval: dt.timedelta | None
    description: str
    next: dt.datetime
    active: bool = True
    last: dt.datetime | None = None
    error: str = ""


def _now() -> dt.datetime:
    return dt.datetime.now(dt.UTC).replace(tzinfo=None)


class Jobs:
    def __init__(self, engine, poll: float = 0.05):
        self.engine, self.poll, self.held, self.counter = engine, poll, {}, 0
        self.deactivate_on_error, self._thread, self._stop = False, None, threading.Event()

    def _keep(self, fn, start, end, interval, description) -> int:
        self.counter += 1
        self.held[self.counter] = Job(self.counter, fn, start, end, interval, str(description), start)
        if self._thread is None:
            self._thread = threading.Thread(target=self._loop, daemon=True)
            self._thread.start()
        return self.counter

    def add(self, fn, start: dt.datetime, end: dt.datetime, interval: dt.timedelta, description: str = "") -> int:
        """Every interval from start to end."""
        return self._keep(fn, start, end, interval, description)

    def add_after(self, fn, interval: dt.timedelta, description: str = "") -> int:
        """Once, after that long."""
        return self._keep(fn, _now() + interval, None, None, description)

    def add_at_time(self, fn, start: dt.datetime, description: str = "") -> int:
        return self._keep(fn, start, None, None, description)

    def _find(self, key: Any) -> list[Job]:
        return [j for j in self.held.values() if j.id == key or isinstance(key, str) and re.search(key, f"{j.fn} {j.description}")]

    def _frame(self, jobs: list[Job]) -> Frame:
        columns = {"id": [j.id for j in jobs], "fn": [str(j.fn) for j in jobs], "next": [j.next for j in jobs], "active": [j.active for j in jobs], "description": [j.description for j in jobs], "error": [j.error for j in jobs]}
        return from_columns(self.engine.spark, columns)

    def list(self) -> Frame:
        return self._frame(list(self.held.values()))

    def get(self, key: Any) -> Frame:
        return self._frame(self._find(key))

    def _switch(self, key: Any, on: bool) -> int:
        found = self._find(key)
        for j in found:
            j.active = on
        return len(found)

    def activate(self, key: Any) -> int:
        return self._switch(key, True)

    def deactivate(self, key: Any) -> int:
        return self._switch(key, False)

    def clear(self) -> None:
        self.held.clear()

    def run_due(self, now: dt.datetime | None = None) -> int:
        """Runs what is due; a job that fails keeps its error, and stops if so set."""
        now, done = now or _now(), 0
        for j in list(self.held.values()):
            if not j.active or j.next > now:
                continue
            try:
                self.engine.call(j.fn)
                done += 1
            except Exception as e:  # a job's error is kept with the job
                j.error, j.active = str(e), not self.deactivate_on_error
            j.last = now
            if j.interval is None:
                j.active = False
            else:
                j.next = max(j.next + j.interval, now)
                j.active = j.active and (j.end is None or j.next <= j.end)
        return done

    def _loop(self) -> None:
        while not self._stop.wait(self.poll):
            self.run_due()

    def stop(self) -> None:
        self._stop.set()
