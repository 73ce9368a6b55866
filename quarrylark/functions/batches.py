"""Arrow batches of long texts: short ones come in, results go out a few at a time, and workers give free memory back."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of a batch that goes to a worker, and texts' characters of one that comes back.
BYTES = 2 << 20


def short(spark: SparkSession) -> None:
    """Batches that go to Python workers end at BYTES, however many rows they could have; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if now > BYTES:
        spark.conf.set(name, str(BYTES))


def portions(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as batches that end once their texts have BYTES characters."""
    held, size = [], 0
    columns = lambda: [pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)]
    for row in rows:
        held.append(row)
        size += 64 + sum(len(v) for v in row if isinstance(v, str))
        if size >= BYTES:
            yield pa.RecordBatch.from_arrays(columns(), schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays(columns(), schema=schema)


def trimmed(run):
    """A function of Arrow batches whose worker gives its free memory back at the end: idle workers are kept for reuse."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def trim() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
