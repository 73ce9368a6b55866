"""Exact duplicates by an exchange of Golomb-coded fingerprints.

1. Every row gets the 64-bit fingerprint and the SHA-256 of its normalised text, and its place: a cell (a run of rows of
   one file) and a number in it. This slim table is written once; texts stay in the JVM.
2. A part (some cells of it) sends each owner (a range of fingerprints) its distinct fingerprints there, sorted and
   Golomb-Rice coded, with one flag bit for those it holds more than once itself.
3. An owner decodes and merges the lists and answers each sender with a bitmap of those held elsewhere too.
4. The part turns its answers into bitmaps of its cells: rows whose bit is set are suspects. The texts are scanned again
   and filtered in place by those bitmaps, so that only suspects' texts are shuffled, whatever their number; they group by
   their bytes, with partial aggregation before the shuffle, so that a text held by a third of all rows is one row for
   each task.

Parts and owners are each the square root of the rows in blocks of BLOCK: the number of blocks grows with the rows, and
a part's or an owner's memory with their square root.

Fingerprints that collide cost a shuffle of the text but nothing else, since bytes decide. Defined results: null text
is empty, rows with empty text are one group; the row with the largest key stays; rows repeated whole share their key,
so each of them says kept where its key does; a null key is smaller than any other, and where all keys of a group are
null its keep_id is null and its rows share that key. survivors() keeps one row of each text even then. An empty table
gives none. Other columns of docs, whatever their names, aren't read and don't clash.
"""

from __future__ import annotations

import math
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import configure, located, mark, marked, materialise, trim, write_shared, shared_folder

#: Fingerprints of one part for one owner, about.
BLOCK = 256


# ---------------------------------------------------------------- Golomb-Rice codes


def rice_encode(sorted_values: np.ndarray, low: int, high: int) -> bytes:
    """Gaps of sorted distinct values in [low, high) as quotient in unary and k bits of remainder."""
    n = len(sorted_values)
    gaps = np.diff(np.concatenate(([np.uint64(low)], sorted_values.astype(np.uint64))))
    k = max(0, int(math.log2(max(1, (high - low) / max(1, n)) * 0.69 + 1)))
    q = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(q + 1)
    unary = np.zeros(int(ends[-1]) if n else 0, np.uint8)
    unary[ends - 1] = 1
    rest = (gaps & np.uint64((1 << k) - 1))[:, None] >> np.arange(k, dtype=np.uint64) & np.uint64(1)
    return struct.pack("<IBQ", n, k, len(unary)) + np.packbits(unary).tobytes() + np.packbits(rest.astype(np.uint8).ravel()).tobytes()


def rice_decode(blob: bytes, low: int) -> np.ndarray:
    n, k, bits = struct.unpack_from("<IBQ", blob)
    at, size = 13, -(-bits // 8)
    unary = np.unpackbits(np.frombuffer(blob, np.uint8, size, at), count=bits)
    q = np.diff(np.concatenate(([-1], np.flatnonzero(unary)))) - 1
    rest = np.unpackbits(np.frombuffer(blob, np.uint8, offset=at + size), count=n * k).reshape(n, k).astype(np.uint64)
    r = (rest << np.arange(k, dtype=np.uint64)).sum(1, dtype=np.uint64) if k else np.zeros(n, np.uint64)
    return np.cumsum((q.astype(np.uint64) << np.uint64(k)) + r, dtype=np.uint64) + np.uint64(low)


# ---------------------------------------------------------------- the exchange


def bounds(owner: int, owners: int) -> tuple[int, int]:
    return -(-(owner << 64) // owners), -(-((owner + 1) << 64) // owners)


def dealt(fp: np.ndarray, owners: int):
    """Distinct fingerprints, how often each occurs, and the borders of the owners among them."""
    fp, counts = np.unique(fp.view(np.uint64), return_counts=True)
    edges = np.searchsorted(fp, np.array([bounds(o, owners)[0] for o in range(owners)], np.uint64))
    return fp, counts, [*edges.tolist(), len(fp)]


def sending(owners: int):
    def run(table: pa.Table) -> pa.Table:
        fp, counts, edges = dealt(table.column("fp").to_numpy(), owners)
        part = table.column("part")[0].as_py()
        some = [o for o in range(owners) if edges[o] < edges[o + 1]]
        codes = [rice_encode(fp[edges[o] : edges[o + 1]], *bounds(o, owners)) for o in some]
        own = [np.packbits(counts[edges[o] : edges[o + 1]] > 1).tobytes() for o in some]
        return pa.Table.from_arrays([pa.array([part] * len(some), pa.int32()), pa.array(some, pa.int32()), pa.array(codes, pa.binary()), pa.array(own, pa.binary())], ["part", "owner", "codes", "own"])

    return run


def answering(owners: int):
    def run(table: pa.Table) -> pa.Table:
        low = bounds(table.column("owner")[0].as_py(), owners)[0]
        lists = [rice_decode(x, low) for x in table.column("codes").to_pylist()]
        own = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(v)).astype(bool) for x, v in zip(table.column("own").to_pylist(), lists, strict=True)]
        _, back, counts = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        many = counts > 1
        many[back[np.concatenate(own)]] = True
        bits, at = [], 0
        for v in lists:
            bits.append(np.packbits(many[back[at : at + len(v)]]).tobytes())
            at += len(v)
        out = pa.Table.from_arrays([table.column("part"), table.column("owner"), pa.array(bits, pa.binary())], ["part", "owner", "bits"])
        del lists, own, back, counts, many
        trim()
        return out

    return run


def matching(owners: int, folder: str):
    """Bitmaps of a part's cells: rows whose bit is set in the answers to it. Gives how many there are."""

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        fp = rows.column("fp").to_numpy().view(np.uint64)
        every, _, edges = dealt(fp, owners)
        many = np.zeros(len(every), bool)
        for o, bits in zip(answers.column("owner").to_pylist(), answers.column("bits").to_pylist(), strict=True):
            many[edges[o] : edges[o + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=edges[o + 1] - edges[o])
        suspect = many[np.searchsorted(every, fp)]
        cells, places = rows.column("cell").to_numpy()[suspect], rows.column("place").to_numpy()[suspect]
        order = np.argsort(cells, kind="stable")
        cells, places = cells[order], places[order]
        starts = np.flatnonzero(np.append(True, cells[1:] != cells[:-1])) if len(cells) else []
        for i, j in zip(starts, [*starts[1:], len(cells)], strict=True):
            bits = np.zeros(1 << 15, bool)
            bits[places[i:j]] = True
            cell = int(cells[i]) & (1 << 64) - 1
            write_shared(f"{folder}/{cell & 255:02x}/{cell:016x}", np.packbits(bits, bitorder="little").tobytes().rstrip(b"\0"))
        trim()
        return pa.Table.from_arrays([pa.array([len(cells)], pa.int64())], ["n"])

    return run


def suspected(slim: DataFrame, n: int) -> str:
    """The exchange over slim (cell, place, fp): folder of the bitmaps of rows whose fingerprint occurs twice."""
    folder = shared_folder(slim.sparkSession, "suspects")
    parts = owners = max(1, math.isqrt(n // BLOCK))
    slim = slim.select("cell", "place", "fp", F.pmod("cell", F.lit(parts)).cast("int").alias("part"))
    sent = slim.select("part", "fp").groupBy("part").applyInArrow(sending(owners), "part int, owner int, codes binary, own binary")
    answers = sent.groupBy("owner").applyInArrow(answering(owners), "part int, owner int, bits binary")
    slim.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(matching(owners, folder), "n long").agg(F.sum("n")).collect()
    return folder


def grouped(rows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """rows: located documents. Of each row: key, cell, place, keep_id, group_size, kept, stays (true for one row of each
    text), sha (of the normalised text)."""
    norm = F.translate(F.coalesce(F.col(text), F.lit("")), *CASE)
    slim = materialise(rows.select(F.col(key).alias("key"), "cell", "place", F.xxhash64(norm).alias("fp"), F.unhex(F.sha2(norm, 256)).alias("sha")), "fingerprints")
    where = marked(suspected(slim, slim.count()))
    texts = rows.filter(where).select(F.col(key).alias("key"), "cell", "place", norm.alias("norm"))
    keep = F.max(F.struct("key", "cell", "place")).alias("keep")
    groups = texts.groupBy("norm").agg(keep, F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")
    groups = materialise(groups.select(F.unhex(F.sha2("norm", 256)).alias("sha"), "keep", "group_size"), "copies")
    # bytes told the groups apart; the digest names a group from here on, so two groups of one digest would be an error
    if groups.groupBy("sha").count().filter("count > 1").limit(1).count():
        raise ValueError("two different texts have one SHA-256")
    names = ["key", "cell", "place"]
    alone = slim.filter(~where).select(*names, F.col("key").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("stays"), "sha")
    found = slim.filter(where).join(groups, "sha", "left").withColumn("keep", F.coalesce("keep", F.struct(*names)))
    found = found.select(*names, F.col("keep.key").alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), (F.struct("cell", "place") == F.struct("keep.cell", "keep.place")).alias("stays"), "sha")
    return alone.unionByName(found).select(*names, "keep_id", "group_size", F.col("keep_id").eqNullSafe(F.col("key")).alias("kept"), "stays", F.lower(F.hex("sha")).alias("sha"))


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: key, keep_id, group_size, kept, sha (of the normalised text)."""
    configure(docs.sparkSession)
    rows = located(docs.select(F.col(key).alias("key"), F.col(text).alias("text")))
    return grouped(rows, "key", "text").select("key", "keep_id", "group_size", "kept", "sha")


def survivors(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without all rows but one of each text: that with the largest key, and of its repetitions the last in place."""
    configure(docs.sparkSession)
    names = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])  # no name clashes with cell and place
    rows = located(inner)
    found = grouped(rows, f"c{names.index(key)}", f"c{names.index(text)}")
    away = mark(found.filter("NOT stays").select("cell", "place"), "copies-away")
    return rows.filter(~marked(away)).drop("cell", "place").toDF(*names)


#: A-Z and a-z.
CASE = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def op8_exact_dedup(spark, sf_dir):
    """Contract query over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_groups(docs).select(F.col("key").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


ORACLES = {
    "op8_exact_dedup": """
        WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM n"""
}
