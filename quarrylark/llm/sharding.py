"""Sharding by vector bin packing over bytes, tokens and rows.

Equal texts are a group and stay together. A group goes to the shard where the dot product of its vector (bytes,
tokens, rows, each as a share of the whole) with the shard's residual capacity is highest, among shards that have room
in bytes. Groups above a fixed share of a shard are placed first, on the driver: shares bound how many there can be.
What is left of each shard's capacity is dealt evenly to packing tasks, and each places its small groups, largest
first, by the same rule. The law kept is `bytes`: shards end within a small group of each other. Only a group larger
than a whole shard's fair share breaks it; such a group stays together and its shard takes nothing else.

Slots count up within (shard, cell); a table of cells, far smaller than the rows, gives the offsets of cells, so no
task orders a whole shard. Defined results: null text counts as empty, of size 1; repeated rows are rows and, as all of
one text, share their shard; a null key is a key; an empty table gives none; other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import configure, materialise

SHARDS = 16
#: A group is large from this share of one shard's bytes; there are at most SHARDS / LARGE of them.
LARGE = 1 / 500
#: Groups that one task packs, about.
TASK_GROUPS = 200_000
CELL_ROWS = 20_000


def place(vectors: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Greedy dot product: vectors (n, 3) in the order given, room (shards, 3) is used up. Gives shard numbers."""
    out = np.empty(len(vectors), np.int32)
    for i, v in enumerate(vectors):
        fits = room[:, 0] >= v[0]
        if fits.any():
            s = int(np.argmax(np.where(fits, room @ v, -np.inf)))
        else:
            s = int(np.argmax(room[:, 0]))
        room[s] -= v
        out[i] = s
    return out


def packing(totals: tuple[int, int, int], residual: list[list[float]], tasks: int):
    """A task's groups against its even part of the residual capacity, corrected to what the task holds."""

    def run(table: pa.Table) -> pa.Table:
        v = np.stack([table.column(c).to_numpy().astype(float) for c in ("bytes", "tokens", "rows")], 1)
        order = np.lexsort((table.column("text_hash").to_numpy(), -v[:, 0]))
        own = v / np.maximum(np.array(totals, float), 1)
        share = np.array(residual)
        # this task's part: the residual in proportion to its own sums, so it uses up all of its capacity
        room = share / np.maximum(share.sum(0), 1e-12) * own.sum(0)
        shard = np.empty(len(v), np.int32)
        shard[order] = place(own[order], room)
        return pa.table([table.column("gid"), pa.array(shard)], names=["gid", "shard"])

    return run


def vector_shards(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """key, size, text_crc32, gid (the group), shard of each row."""
    spark = docs.sparkSession
    configure(spark)
    t = F.coalesce(F.col(text), F.lit(""))
    slim = docs.select(
        F.col(key).alias("key"), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(F.encode(t, "UTF-8")).alias("text_crc32"), F.unhex(F.sha2(t, 256)).alias("gid"),
        F.regexp_count(t, F.lit("[^ \\t\\n\\x0B\\f\\r]+")).cast("long").alias("n_tokens"),
    )
    slim = materialise(slim, "sizes")
    groups = materialise(slim.groupBy("gid").agg(F.sum("size").alias("bytes"), F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")).withColumn("text_hash", F.xxhash64("gid")), "groups")
    total = groups.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("bytes", "tokens", "rows")], F.count(F.lit(1))).first()
    totals, n = tuple(total)[:3], total[3]
    least = totals[0] / shards * LARGE
    large = groups.filter(F.col("bytes") >= least).orderBy(F.desc("bytes"), "gid").toPandas()
    room = np.full((shards, 3), 1 / shards)
    v = large[["bytes", "tokens", "rows"]].to_numpy(float) / np.maximum(np.array(totals, float), 1)
    first = place(v, room)
    tasks = max(1, -(-n // TASK_GROUPS))
    small = groups.filter(F.col("bytes") < least).withColumn("task", F.pmod("text_hash", F.lit(tasks)).cast("int"))
    residual = np.maximum(room, 0).tolist()
    placed = small.groupBy("task").applyInArrow(packing(totals, residual, tasks), "gid binary, shard int")
    if len(large):
        fixed = spark.createDataFrame([(bytes(g), int(s)) for g, s in zip(large["gid"], first, strict=True)], "gid binary, shard int")
        placed = placed.unionByName(fixed)
    return slim.join(placed, "gid").select("key", "size", "text_crc32", "n_tokens", "gid", "shard")


def slots(placed: DataFrame) -> DataFrame:
    """Adds slot, gapless from 0 in each shard."""
    n = placed.count()
    cells = max(1, n // (CELL_ROWS * SHARDS))
    dealt = placed.withColumn("cell", F.pmod(F.xxhash64("key", F.lit(3)), F.lit(cells)).cast("int"))
    before = dealt.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("shard", "cell", (F.sum("n").over(Window.partitionBy("shard").orderBy("cell")) - F.col("n")).alias("before"))
    w = Window.partitionBy("shard", "cell").orderBy("key", "text_crc32")
    return dealt.withColumn("place", F.row_number().over(w) - 1).join(before, ["shard", "cell"]).withColumn("slot", (F.col("before") + F.col("place")).cast("long")).drop("before", "place", "cell")


def op10_vector_shards(spark, sf_dir):
    """Contract query over all documents; the law is `bytes`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    placed = materialise(vector_shards(docs), "placed")
    return slots(placed).select(F.col("key").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "n_tokens")
