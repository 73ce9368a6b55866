"""Shared plumbing of the training-data operators: shared storage, row marks, readers, hashing."""

from __future__ import annotations

import functools
import os
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylark.functions.batches import trim, trimmed  # noqa: F401
from quarrylark.operators.components import connected  # noqa: F401
from quarrylark.storage import materialise, shared_folder, shared_root  # noqa: F401

#: Rows in one Arrow batch: texts may be very long, so batches stay short and their bytes bounded.
BATCH_ROWS = 1000
BATCH_BYTES = 2 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def configure(spark: SparkSession) -> None:
    """Session settings for Arrow exchange with Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def posix(uri: str) -> str:
    """Path of a ``file:`` URI: workers map model files, which needs a shared POSIX mount."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    if "://" in uri:
        raise ValueError(f"memory-mapped files need a shared POSIX folder, not {uri}")
    return uri


# ---------------------------------------------------------------- marks on rows


def file_backed(df: DataFrame) -> bool:
    """df is columns and filters over Parquet files alone, so that a row's file and place in it name the row in every scan."""
    node = df._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias", "View"):
        node = node.children().head()
    if not node.nodeName().startswith(("Relation", "LogicalRelation")) or not df.inputFiles():
        return False
    return node.relation().getClass().getSimpleName() == "HadoopFsRelation" and "Parquet" in node.relation().fileFormat().toString()  # no other format numbers its rows


def located(docs: DataFrame) -> DataFrame:
    """docs with cell (a run of rows of one file, long) and place (int, in the cell) of each row, the same in every scan.

    What isn't a scan of Parquet files is written to the shared folder first. Cells grow with the table, from 2^8 rows to the 2^15
    that one bitmap holds.
    """
    if not file_backed(docs):
        docs = materialise(docs, "rows")
    bits = min(15, max(8, (docs.count() >> 8).bit_length()))
    at = F.col("_metadata.row_index")
    return docs.select("*", F.xxhash64("_metadata.file_path", F.shiftright(at, bits)).alias("cell"), at.bitwiseAND((1 << bits) - 1).cast("int").alias("place"))


def mark(rows: DataFrame, name: str) -> str:
    """Write the bitmaps of rows (cell, place), a small file for each cell that has any; gives their folder."""
    folder = shared_folder(rows.sparkSession, name)

    def run(batches):
        n = 0
        for b in batches:
            for cell, bits in zip(b.column("cell").to_pylist(), b.column("bits").to_pylist(), strict=True):
                write_shared(f"{folder}/{cell & 255:02x}/{cell & (1 << 64) - 1:016x}", bits.rstrip(b"\0"))
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    rows.groupBy("cell").agg(F.bitmap_construct_agg("place").alias("bits")).mapInArrow(run, "n long").agg(F.sum("n")).collect()
    return folder


@functools.lru_cache(64)
def bitmap(folder: str, cell: int) -> np.ndarray:
    raw = read_shared(f"{folder}/{cell & 255:02x}/{cell & (1 << 64) - 1:016x}")
    # padded here: unpackbits leaves what it adds to an empty array unset
    return np.unpackbits(np.frombuffer((raw or b"").ljust(1 << 12, b"\0"), np.uint8), bitorder="little").astype(bool)


def marked(folder: str) -> Column:
    """Test of a located row. Only cell and place go to Python, no other column of the row."""

    def test(cell: pa.Array, place: pa.Array) -> pa.Array:
        cells, places = cell.to_numpy(zero_copy_only=False), place.to_numpy(zero_copy_only=False)
        out = np.zeros(len(cells), bool)
        for c in np.unique(cells):
            own = cells == c
            out[own] = bitmap(folder, int(c))[places[own]]
        return pa.array(out)

    test.__annotations__ = {"cell": pa.Array, "place": pa.Array, "return": pa.Array}
    return F.arrow_udf(test, "boolean")("cell", "place")


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of df's size; for a file scan the size of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def write_atomic(path: str, data: bytes) -> None:
    """A retried or speculative task writes the same bytes again; the rename makes either copy whole."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    temp = f"{path}.{uuid.uuid4().hex}"
    with open(temp, "wb") as f:
        f.write(data)
    os.replace(temp, path)


def write_shared(uri: str, data: bytes) -> None:
    """write_atomic() in any store that pyarrow reaches; object stores write a file whole or not at all."""
    if uri.startswith("file:") or "://" not in uri:
        return write_atomic(posix(uri), data)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(path) as f:
        f.write(data)


def read_shared(uri: str) -> bytes | None:
    """The bytes written, or None where there is no such file."""
    if uri.startswith("file:") or "://" not in uri:
        try:
            with open(posix(uri), "rb") as f:
                return f.read()
        except FileNotFoundError:
            return None
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    if store.get_file_info(path).type == fs.FileType.NotFound:
        return None
    with store.open_input_stream(path) as f:
        return f.read()


def texts_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes; cheaper than looking words up in a memo."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, on arrays."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words_of(text: bytes) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of the text with A-Z in lower case."""
    return text.lower().split()


def learns(column="doc_id", parts: int = 5, held: int = 1):
    """Column: the row is for learning, not held out."""
    return F.crc32(F.col(column).cast("string")) % parts != held


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of frames that are no longer held."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
