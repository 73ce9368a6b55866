"""One file, in order, written by many tasks.

Rows are range-partitioned and sorted once; the byte lengths of the partitions, one number each, sum up to where each
begins, and every row carries its own place in the file. A data source writer then puts each row's bytes at its place, in
any order and from any task: a task that is tried again, or runs twice, writes the same bytes to the same place. The file
has another name until all tasks are done; commit renames it, abort deletes it.

Tasks write into one file where the folder is a POSIX mount that all machines share. In another store each sorted
partition becomes a file, and these are joined in order through the driver's file system client, a buffer at a time.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from quarrylark.sources.io import write_text
from quarrylark.storage import materialise

#: Neighbouring rows are written at once up to so many bytes.
BUFFER = 1 << 20


def posix(path: str) -> str | None:
    """The path on a mount, None of another store's."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return None if "://" in path else path


@dataclass
class Written(WriterCommitMessage):
    n: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, temp: str, path: str, size: int):
        self.temp, self.path, self.size = temp, path, size

    def write(self, iterator: Iterator) -> Written:
        out, total = os.open(self.temp, os.O_WRONLY), 0
        try:
            for batch in iterator:
                at, texts = batch.column("at").to_numpy(), batch.column("bytes").cast(pa.large_binary())
                if not len(at):
                    continue
                ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(at) + 1]
                data = memoryview(texts.buffers()[2] or b"")
                breaks = np.flatnonzero(at[1:] != at[:-1] + np.diff(ends)[:-1]) + 1
                for i, j in pairwise([0, *breaks.tolist(), len(at)]):  # rows that follow each other lie side by side in the batch
                    total += self._put(out, int(at[i]), data[ends[i] : ends[j]])
            os.fsync(out)
        finally:
            os.close(out)
        return Written(total)

    @staticmethod
    def _put(out: int, at: int, data: memoryview) -> int:
        for i in range(0, len(data), BUFFER):
            block, done = data[i : i + BUFFER], 0
            while done < len(block):
                done += os.pwrite(out, block[done:], at + i + done)
        return len(data)

    def commit(self, messages: list) -> None:
        if (n := sum(m.n for m in messages if m)) != self.size:
            self.abort(messages)
            raise RuntimeError(f"{n} bytes of {self.size} were written")
        os.replace(self.temp, self.path)

    def abort(self, messages: list) -> None:
        if os.path.exists(self.temp):
            os.remove(self.temp)


class Bytes(DataSource):
    """Sink of rows (at long, bytes binary) into a file of a known size. Options: temp, path, size."""

    @classmethod
    def name(cls) -> str:
        return "bytes_at"

    def schema(self) -> str:
        return "at long, bytes binary"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["temp"], self.options["path"], int(self.options["size"]))


def _sorted(df: DataFrame, order: list | None, text: Column) -> DataFrame:
    """b (bytes), _p (partition), _i (place in it) of all rows in order, written once; without an order the rows have their _p and _i."""
    low = F.lit((1 << 33) - 1)
    if order is None:
        return materialise(df.select(F.encode(F.coalesce(text, F.lit("")), "UTF-8").alias("b"), "_p", "_i"), "lines")
    rows = df.orderBy(*order).select(F.encode(F.coalesce(text, F.lit("")), "UTF-8").alias("b"), F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().bitwiseAND(low).alias("_i"))
    return materialise(rows, "lines")


def placed(rows: DataFrame, between: str, head: str) -> tuple[DataFrame, int, int]:
    """Rows (at, bytes), their number, and the bytes of head and rows; all rows but the first carry `between` before them."""
    gap, at, starts, count = len(between.encode()), len(head.encode()), [], 0
    for p, n, size in sorted(map(tuple, rows.groupBy("_p").agg(F.count(F.lit(1)), F.sum(F.octet_length("b"))).collect())):
        starts.append((p, at, not starts))
        at += size + gap * (n - (not count))
        count += n
    where = rows.sparkSession.createDataFrame(starts, "_p int, _at long, _first boolean")
    joined = rows.join(F.broadcast(where), "_p")  # one row a partition
    own = F.when(F.col("_first") & (F.col("_i") == 0), F.col("b")).otherwise(F.concat(F.encode(F.lit(between), "UTF-8"), "b"))
    upto = Window.partitionBy("_p").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    joined = joined.select("_p", "_i", "_at", own.alias("bytes"))
    return joined.select((F.col("_at") + F.coalesce(F.sum(F.octet_length("bytes")).over(upto), F.lit(0))).alias("at"), "bytes"), count, at


def write_file(df: DataFrame, path: str, order: list | None, text: Column, between: str = "\n", head: str = "", tail: str = "\n", empty: str = "") -> int:
    """One file of the rows' texts in a total order, `between` them, after head and before tail; `empty` where there is no row. Gives its bytes.

    order None: rows come with _p and _i (`ordering.running_number`). A null text is empty. A file that is there already is replaced when the new one is whole.
    """
    spark = df.sparkSession
    lines = _sorted(df, order, text)
    rows, count, size = placed(lines, between, head)
    if not count:
        write_text(spark, path, empty)
        return len(empty.encode())
    mount = posix(path)
    if mount is None:
        return joined(spark, lines, path, between, head, tail)
    size += len(tail.encode())
    os.makedirs(os.path.dirname(mount) or ".", exist_ok=True)
    temp = f"{mount}.{uuid.uuid4().hex}"
    with open(temp, "wb") as f:
        f.truncate(size)
        f.write(head.encode())
        f.seek(size - len(tail.encode()))
        f.write(tail.encode())
    spark.dataSource.register(Bytes)
    rest = size - len(head.encode()) - len(tail.encode())
    rows.write.format("bytes_at").mode("append").options(temp=temp, path=mount, size=str(rest)).save()
    return size


def joined(spark: SparkSession, lines: DataFrame, path: str, between: str, head: str, tail: str) -> int:
    """Sorted partitions as text files, joined by the file system's client a buffer at a time; `between` can't be empty here."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    parts, temp = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.parts"), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    try:
        ordered = lines.repartitionByRange("_p", "_i").sortWithinPartitions("_p", "_i")
        ordered.select(F.decode("b", "UTF-8").alias("value")).write.option("lineSep", between).text(parts.toString())
        files = sorted((s.getPath().getName(), s.getPath(), s.getLen()) for s in fs.listStatus(parts) if s.getLen() and s.getPath().getName().startswith("part-"))
        out = fs.create(temp, True)
        out.write(bytearray(head.encode()))
        for name, where, size in files:
            source = fs.open(where)
            cut = len(between.encode()) if name == files[-1][0] else 0  # the writer ends every line
            jvm.org.apache.commons.io.IOUtils.copyLarge(source, out, 0, size - cut)
            source.close()
        out.write(bytearray(tail.encode()))
        out.close()
        fs.delete(target, False)
        fs.rename(temp, target)
    finally:
        fs.delete(parts, True)
    return fs.getFileStatus(target).getLen()


def csv_line(columns: list[str]) -> Column:
    """A CSV record: minimal quotes, doubled; null is empty, and a record of one empty field is quoted."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    quoted = [F.when(t.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t) for t in text]
    if len(columns) == 1:
        quoted = [F.when(text[0] == "", '""').otherwise(quoted[0])]
    return F.concat_ws(",", *quoted)


def write_csv_file(df: DataFrame, path: str, order: list) -> int:
    """df as one CSV file with a header, in order, lines ended by CR LF."""
    header = df.sparkSession.createDataFrame([tuple(df.columns)], [f"c{i}" for i in range(len(df.columns))]).select(csv_line([f"c{i}" for i in range(len(df.columns))])).first()[0]
    return write_file(df, path, order, csv_line(df.columns), "\r\n", header + "\r\n", "\r\n", header + "\r\n")
