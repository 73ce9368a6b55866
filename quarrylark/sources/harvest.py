"""A search service by days as a source: spark.read.format("harvest") and, with its offset kept by Spark, spark.readStream.

Batch (`ask`): conditions on `day` become the window that the service is asked for, and words that `text` has to hold are handed
to it too. A service matches words loosely, so Spark tests those again; a window is exact. `columns` are asked for, others
are null, and `most` keeps the newest rows alone. The window is split until a piece holds no more than the service lets
out (`cap`), a piece is a partition, and a lost task asks for its piece again.

Stream: the offset is the last day that a run has seen whole. The next run starts `overlap` days before it, as answers may
appear late, and `once` drops what an earlier run has brought. A batch read with a window of its own moves no offset.

A transport is a module-level class made from the options, with `count(words, lo, hi)`, `page(words, lo, hi, cursor,
columns)` that gives (rows as dictionaries, newest first, next cursor or ''), and `today()`. `Staged` answers from Parquet.
"""

from __future__ import annotations

import datetime as dt
import importlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, StringContains

from quarrylark.sources.search import patient, resume_from, split_window

COLUMNS = ["id", "day", "text", "value"]
FIRST, LAST = "1900-01-01", "2999-12-31"
WORD = re.compile(r"\w+")


@dataclass
class Piece(InputPartition):
    """A window, and how many of its newest rows are wanted (-1: all)."""

    lo: str
    hi: str
    most: int = -1


def _day(value, add: int = 0) -> str:
    """An ISO day, moved; '' where value is none."""
    try:
        return (dt.date.fromisoformat(value) + dt.timedelta(days=add)).isoformat() if len(value) == 10 else ""
    except (TypeError, ValueError):
        return ""


class _Asking:
    """What readers share: the transport and the rows of a piece."""

    def __init__(self, options: dict[str, str]):
        self.options = options
        self.words: list[str] = WORD.findall(options.get("query", "").lower())
        self.columns = [c.strip() for c in options["columns"].split(",")] if options.get("columns") else COLUMNS

    def transport(self):
        module, _, name = self.options.get("transport", "quarrylark.sources.harvest.Staged").rpartition(".")
        return getattr(importlib.import_module(module), name)(self.options)

    def pieces(self, lo: str, hi: str) -> list[Piece]:
        t = self.transport()
        found = split_window(lambda a, b: patient(lambda: t.count(self.words, a, b)), lo, hi, int(self.options.get("cap", "9000")))
        most = int(self.options.get("most", "-1"))
        if most < 0:
            return [Piece(a, b) for a, b in found]
        out = []
        for a, b in reversed(found):  # the newest first, until there are enough
            if most <= 0:
                break
            n = patient(lambda a=a, b=b: t.count(self.words, a, b))
            out.append(Piece(a, b, min(n, most)))
            most -= n
        return out

    def read(self, partition: Piece) -> Iterator[tuple]:
        if not partition.lo:
            return
        t, cursor, left = self.transport(), "", partition.most
        while left:
            rows, cursor = patient(lambda c=cursor: t.page(self.words, partition.lo, partition.hi, c, self.columns))
            for r in rows[:left] if left > 0 else rows:
                yield tuple(r.get(c) if c in self.columns else None for c in COLUMNS)
            left = max(0, left - len(rows)) if left > 0 else left
            if not cursor:
                return


class _Whole(_Asking, DataSourceReader):
    """A window as the options give it."""

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.lo, self.hi = options.get("from") or FIRST, options.get("to") or LAST

    def partitions(self) -> list[Piece]:
        return self.pieces(self.lo, self.hi) or [Piece("", "")]


class _Batch(_Whole):
    """A window and words narrowed by the conditions of a query."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        moves = {GreaterThanOrEqual: (0, None), GreaterThan: (1, None), LessThanOrEqual: (None, 0), LessThan: (None, -1), EqualTo: (0, 0)}
        for f in filters:
            if type(f) in moves and f.attribute == ("day",) and _day(f.value) and "day" in self.columns:
                up, down = moves[type(f)]
                self.lo = self.lo if up is None else max(self.lo, _day(f.value, up))
                self.hi = self.hi if down is None else min(self.hi, _day(f.value, down))
                continue
            if isinstance(f, StringContains) and f.attribute == ("text",):
                # whole words between others are asked for; the first and the last may be parts of words
                self.words += WORD.findall(f.value.lower())[1:-1]
            yield f


class _Stream(_Asking, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"done": ""}

    def latestOffset(self) -> dict:
        return {"done": self.transport().today()}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        lo = resume_from(start["done"], self.options.get("from") or FIRST, int(self.options.get("overlap", "14")))
        return self.pieces(lo, end["done"]) or [Piece("", "")]


class Harvest(DataSource):
    """Options: transport and what it needs, query, from, to, columns, cap, most, push (as ask() sets it); of a stream also overlap (days)."""

    @classmethod
    def name(cls) -> str:
        return "harvest"

    def schema(self) -> str:
        return ", ".join(f"{c} string" for c in COLUMNS)

    def reader(self, schema) -> DataSourceReader:
        pushed = self.options.get("push", "false").lower() == "true"
        return (_Batch if pushed else _Whole)(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(dict(self.options))


def register(spark: SparkSession) -> None:
    """The source, and the session's setting that hands conditions to sources in Python."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Harvest)


def ask(spark: SparkSession, test: Column | None = None, **options: str) -> DataFrame:
    """Answers under a condition, as much of which as possible reaches the service.

    Spark 4.1 plans a source in Python anew only for a query with a condition that can be handed on, and else takes what the
    last query on the same relation has left. So there always is one here, the first day, also below further conditions.
    """
    df = spark.read.format("harvest").options(**options, push="true").load()
    df = df.filter(F.col("day") >= (options.get("from") or FIRST))
    return df if test is None else df.filter(test)


def once(stream: DataFrame, overlap: int = 14) -> DataFrame:
    """Rows of a stream whose id no earlier run has brought; ids are kept for twice the overlap, longer than any run looks back."""
    timed = stream.withColumn("_at", F.to_timestamp("day")).withWatermark("_at", f"{2 * overlap} days")
    return timed.dropDuplicatesWithinWatermark(["id"]).drop("_at")


class Staged:
    """Answers from a Parquet folder `staged` with id, day, text, value and indexed, the day from which the service has a row.

    The service's own day is the text file `clock`, if given, else the last day there is.
    """

    PAGE = 200

    def __init__(self, options: dict[str, str]):
        from pyarrow import dataset, fs

        store, path = fs.FileSystem.from_uri(options["staged"]) if "://" in options["staged"] or options["staged"].startswith("file:") else (fs.LocalFileSystem(), options["staged"])
        self.data = dataset.dataset(path, filesystem=store, format="parquet")
        self.clock = LAST
        if options.get("clock"):
            store, path = fs.FileSystem.from_uri(options["clock"]) if ":" in options["clock"] else (fs.LocalFileSystem(), options["clock"])
            with store.open_input_stream(path) as f:
                self.clock = f.read().decode().strip()
        self.kept: tuple = ()

    def _where(self, words: list[str], lo: str, hi: str):
        import pyarrow.compute as pc

        test = (pc.field("day") >= lo) & (pc.field("day") <= hi) & (pc.field("indexed") <= self.clock)
        for w in words:
            test = test & pc.match_substring(pc.field("text"), w, ignore_case=True)
        return test

    def today(self) -> str:
        if self.clock != LAST:
            return self.clock
        import pyarrow.compute as pc

        return max((pc.max(b.column("indexed")).as_py() or "" for b in self.data.to_batches(columns=["indexed"]) if len(b)), default=FIRST)

    def count(self, words: list[str], lo: str, hi: str) -> int:
        return self.data.count_rows(filter=self._where(words, lo, hi))

    def page(self, words: list[str], lo: str, hi: str, cursor: str, columns: list[str]) -> tuple[list[dict], str]:
        asked = (tuple(words), lo, hi)
        if not self.kept or self.kept[0] != asked:
            need = sorted({*columns, "day", "id"})
            self.kept = asked, self.data.to_table(columns=need, filter=self._where(words, lo, hi)).sort_by([("day", "descending"), ("id", "ascending")])
        rows, at = self.kept[1], int(cursor or 0)
        end = at + self.PAGE
        return rows.slice(at, self.PAGE).to_pylist(), str(end) if end < len(rows) else ""
