"""A search service as a batch source: spark.read.format("search") over a date window.

The transport is the caller's: a module-level class with `count(query, lo, hi)` and `page(query, lo, hi, cursor)` that
returns (rows of JSON text, next cursor or ''). The window is halved until a piece holds no more than the service lets out,
a piece is a partition, and a lost task asks for its piece again.
"""

from __future__ import annotations

import datetime as dt
import importlib
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def split_window(count: Callable[[str, str], int], lo: str, hi: str, cap: int) -> list[tuple[str, str]]:
    """Date pieces of lo..hi, none of which counts above cap unless it is a single day; empty ones are left out."""
    a, b = dt.date.fromisoformat(lo), dt.date.fromisoformat(hi)
    if a > b or not (n := count(lo, hi)):
        return []
    if n <= cap or a == b:
        return [(lo, hi)]
    middle = a + (b - a) // 2
    return split_window(count, lo, middle.isoformat(), cap) + split_window(count, (middle + dt.timedelta(days=1)).isoformat(), hi, cap)


class Busy(Exception):
    """The service asks for a wait, in seconds if it says so."""

    def __init__(self, seconds: float | None = None):
        super().__init__(seconds)
        self.seconds = seconds


class GivenUp(Exception):
    """A wait longer than a run can bear, or too many tries."""


def patient(call: Callable, tries: int = 6, first: float = 2.0, most: float = 120.0, give_up: float = 600.0, sleep: Callable[[float], None] = time.sleep):
    """call(), again after a doubling wait (or the one asked for) while the service is busy."""
    wait = first
    for left in range(tries - 1, -1, -1):
        try:
            return call()
        except Busy as e:
            pause = wait if e.seconds is None else e.seconds
            if pause > give_up or not left:
                raise GivenUp(f"wait of {pause:g} s after {tries - left} tries") from e
            sleep(pause)
            wait = min(most, wait * 2)
    return None


class Pace:
    """A least interval between two requests to one host, within a process."""

    def __init__(self, interval: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.interval, self.clock, self.sleep = interval, clock, sleep
        self.next: dict[str, float] = {}

    def wait(self, host: str) -> float:
        """Sleep until the host may be asked again; gives the seconds slept."""
        now = self.clock()
        pause = max(0.0, self.next.get(host, now) - now)
        if pause:
            self.sleep(pause)
        self.next[host] = now + pause + self.interval
        return pause


@dataclass
class Piece(InputPartition):
    lo: str
    hi: str


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def _transport(self):
        module, _, name = self.options["transport"].rpartition(".")
        return getattr(importlib.import_module(module), name)()

    def partitions(self) -> list[Piece]:
        o, t = self.options, self._transport()
        pieces = split_window(lambda lo, hi: patient(lambda: t.count(o["query"], lo, hi)), o["from"], o["to"], int(o.get("cap", "9000")))
        return [Piece(*p) for p in pieces] or [Piece("", "")]

    def read(self, partition: Piece) -> Iterator[tuple[str]]:
        if not partition.lo:
            return
        t, cursor = self._transport(), ""
        while True:
            rows, cursor = patient(lambda c=cursor: t.page(self.options["query"], partition.lo, partition.hi, c))
            yield from ((r,) for r in rows)
            if not cursor:
                return


class Search(DataSource):
    """Options: transport (path of the class), query, from, to (ISO dates), cap."""

    @classmethod
    def name(cls) -> str:
        return "search"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def resume_from(last_complete: str, start: str, overlap: int = 14) -> str:
    """Where the next run begins: the last complete one less the overlap, never before the start."""
    if not last_complete:
        return start
    return max(start, (dt.date.fromisoformat(last_complete) - dt.timedelta(days=overlap)).isoformat())
