"""Sequence packing by minimum bin slack.

Documents become token ids plus one closing id 0 and are cut into pieces of the sequence length, the short piece first.
Full pieces are sequences already. The others are dealt at random into bounded blocks, and in a block each bin starts
with the longest piece left; a bitset subset-sum over the lengths left (an integer whose bit s says that s tokens can
be reached) finds the fullest combination, which leaves the block. Only bins that end with slack reopen: their pieces
go through a second round in far fewer blocks, so that blocks cost no more than a few bins.

A piece has a hash of its ids; ids stay where they are, the plan is (document, piece, sequence, offset). Defined
results: null text is empty and packs as its closing id; repeated rows are packed each; rows with null or equal keys too;
an empty table gives none; other columns of the documents aren't read.
"""

from __future__ import annotations

import base64
import functools
import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import configure, materialise, texts_of, trimmed

LENGTH = 2048
#: Pieces in a block: what one task packs in memory.
BLOCK_PIECES = 50_000


def encoder(path: str | None = None):
    """texts -> list of id lists, the ids of the tokenizers library for the byte-level vocabulary.

    The vocabulary is read as ranks and encoded by tiktoken, four times as fast with equal ids (tested); texts
    that it refuses go to the tokenizers library itself. An added token in a text is its own id, as the file has it.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    ranks_file = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    slow: list = []

    def ids(text: str) -> list[int]:
        try:
            return fast.encode(text, allowed_special="all") if any(t in text for t in added) else fast.encode_ordinary(text)
        except BaseException as e:  # a panic in the native code isn't an Exception, and its type can't be imported
            if not isinstance(e, Exception) and type(e).__name__ != "PanicException":
                raise
            if not slow:
                slow.append(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
            return slow[0].encode(text, add_special_tokens=False).ids

    return ids


@functools.lru_cache(2)
def shared_encoder(path: str | None = None):
    """One for each worker, for all its tasks."""
    return encoder(path)


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """key, piece, start, length, ids_crc32 of every piece."""

    @trimmed
    def run(batches):
        ids = shared_encoder()
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for k, t in zip(b.column("key").to_pylist(), texts_of(b, "text"), strict=True):
                a = np.array([*ids(t.decode()), 0], "<u4")
                first = len(a) % length or length
                starts = [0, *range(first, len(a), length)]
                for p, s in enumerate(starts):
                    e = first if p == 0 else s + length
                    for c, x in zip(out, (k, p, s, e - s, zlib.crc32(a[s:e].tobytes())), strict=True):
                        c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], b.schema.field("key").type), pa.array(out[1], pa.int32()), *[pa.array(x, pa.int64()) for x in out[2:]]], ["key", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, piece int, start long, length long, ids_crc32 long")


def fullest(counts: np.ndarray, room: int, smallest: int) -> list[int]:
    """The multiset of lengths with the largest sum up to room, by bitset subset-sum; exact over all lengths left.

    reach[i] is the set of sums of the first i (length, times) entries; times are split into powers of two, so a
    length held often costs a logarithm of its use.
    """
    if room < smallest:
        return []
    mask = (1 << (room + 1)) - 1
    steps, reach, full = [], [1], 1 << room
    usable = np.flatnonzero(counts[: room + 1])
    for x in usable[::-1].tolist():
        left, times = min(int(counts[x]), room // x), 1
        while left > 0:
            times = min(times, left)
            steps.append((x, times))
            reach.append((reach[-1] | reach[-1] << x * times) & mask)
            left -= times
            times *= 2
        if reach[-1] & full:
            break
    s, chosen = reach[-1].bit_length() - 1, []
    for i in range(len(steps) - 1, -1, -1):
        if not reach[i] >> s & 1:
            x, times = steps[i]
            chosen += [x] * times
            s -= x * times
    return chosen


def pack_lengths(lengths: np.ndarray, size: int = LENGTH) -> list[list[int]]:
    """Bins of row numbers for lengths of at most size."""
    order = np.argsort(lengths, kind="stable")
    counts = np.bincount(lengths, minlength=size + 1)
    ends = np.cumsum(counts)
    top, smallest, bins = size, int(lengths.min()), []
    while True:
        while top and not counts[top]:
            top -= 1
        if not top:
            return bins
        while not counts[smallest]:
            smallest += 1
        counts[top] -= 1
        own = [top]
        if top + smallest <= size:
            more = fullest(counts, size - top, smallest)
            for x in more:
                counts[x] -= 1
            own += more
        rows = []
        for x in own:
            ends[x] -= 1
            rows.append(int(order[ends[x]]))
        bins.append(rows)


def packing(size: int, final: bool):
    def run(table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_numpy()
        block = table.column("block")[0].as_py()
        bin_of, offset, slack = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), np.zeros(len(lengths), bool)
        for i, rows in enumerate(pack_lengths(lengths, size)):
            own = lengths[rows]
            bin_of[rows], offset[rows], slack[rows] = i, np.cumsum(own) - own, own.sum() < size
        reopen = slack & (not final)
        seq = (np.int64(block) << np.int64(32)) + bin_of + (np.int64(1) << np.int64(61) if final else np.int64(0))
        return pa.table([table.column("key"), table.column("piece"), table.column("start"), table.column("length"), table.column("ids_crc32"), pa.array(seq), pa.array(offset), pa.array(reopen)], names=["key", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "reopen"])

    return run


def best_fit(found: DataFrame, size: int = LENGTH) -> DataFrame:
    """Place pieces(): adds sequence_id and offset."""
    spark = found.sparkSession
    kind = found.schema["key"].dataType.simpleString()
    columns = ["key", "piece", "start", "length", "ids_crc32"]
    schema = f"key {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, reopen boolean"
    found = materialise(found, "pieces")
    # whole sequences need no packing; their ids are negative
    full = found.filter(F.col("length") == size).select(*columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    part = found.filter(F.col("length") < size)
    n = part.count()

    def dealt(df, n):
        blocks = max(1, round(n / BLOCK_PIECES))
        return df.withColumn("block", F.pmod(F.xxhash64("key", "piece", F.lit(7)), F.lit(blocks)).cast("int"))

    first = materialise(dealt(part, n).groupBy("block").applyInArrow(packing(size, False), schema), "packed")
    again = first.filter("reopen").select(*columns)
    second = dealt(again, again.count()).groupBy("block").applyInArrow(packing(size, True), schema)
    keep = [*columns, "sequence_id", "offset"]
    return full.select(keep).unionByName(first.filter("not reopen").select(keep)).unionByName(second.select(keep))


def op9_best_fit(spark, sf_dir):
    """Contract query over all documents."""
    configure(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return best_fit(pieces(docs)).withColumnRenamed("key", "doc_id")
