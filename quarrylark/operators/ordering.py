"""Places in a total order, and running numbers and sums within keys, without sending all rows or one hot key to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylark.storage import materialise


def running_number(df: DataFrame, order: list, name: str = "n", parts: bool = False) -> DataFrame:
    """Places from 1 in a total order: a range-partitioned sort is written, then each partition adds the sizes of those before it.

    The driver sees one count for each partition, nothing of the rows. parts keeps _p (partition, in order) and _i (place in it, from 0).
    """
    low = F.lit((1 << 33) - 1)
    sorted_ = materialise(df.orderBy(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND(low)), "sorted")
    before, starts = 0, []
    for p, n in sorted(map(tuple, sorted_.groupBy("_p").count().collect())):
        starts.append((p, before))
        before += n
    places = df.sparkSession.createDataFrame(starts, "_p int, _s long")
    out = sorted_.join(F.broadcast(places), "_p").withColumn(name, F.col("_s") + F.col("_i") + 1).drop("_s")  # one row a partition
    return out if parts else out.drop("_p", "_i")


def running_within(df: DataFrame, keys: list[str], order: list, number: str = "n", sums: dict[str, Column] | None = None) -> DataFrame:
    """df with the place from 1 of each row among the rows of its keys, and for each name in sums the running total of a column.

    The same as row_number and a running sum over a window of the keys, but a key may hold any share of the rows: rows
    are range-partitioned by keys and order, so that a hot key lies in many neighbouring partitions; each partition
    numbers its own part of a key, and the parts before it are added. A key has a part in at most as many partitions
    as there are, and only the first and the last key of a partition can have parts in others: two rows a partition is what
    is carried over, whatever the number of rows or keys. Null keys are one key. The order should be total: rows that
    it leaves equal may swap their places. Sums are of long or decimal columns; a null adds nothing. The names _p, _q,
    _n, _b, _c, _s0, _k0 and so on are used inside.
    """
    sums = sums or {}
    names = [f"_s{i}" for i in range(len(sums))]
    by = [F.asc_nulls_first(k) for k in keys]
    ranged = df.withColumns({s: F.coalesce(c, F.lit(0)) for s, c in zip(names, sums.values(), strict=True)}).repartitionByRange(*by, *order)
    rows = materialise(ranged.withColumn("_p", F.spark_partition_id()), "ranged")
    part = Window.partitionBy("_p", *keys)
    upto = part.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.withColumns({"_n": F.row_number().over(part.orderBy(*order)).cast("long"), **{f"{s}r": F.sum(s).over(upto) for s in names}})
    parts = rows.groupBy("_p", *keys).agg(F.count(F.lit(1)).alias("_c"), *[F.sum(s).alias(f"{s}t") for s in names])
    # keys that lie in several partitions: only the first and the last key of a partition can
    torn = parts.groupBy(*keys).agg(F.min("_p").alias("_from"), F.max("_p").alias("_to")).filter("_from < _to")
    torn = torn.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    pieces = parts.join(torn, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], "left_semi")
    earlier = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    carried = pieces.select("_p", *keys, F.sum("_c").over(earlier).alias("_b"), *[F.sum(f"{s}t").over(earlier).alias(f"{s}b") for s in names]).filter("_b IS NOT NULL")
    carried = carried.select(F.col("_p").alias("_q"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_b", *[f"{s}b" for s in names])
    met = F.col("_p") == F.col("_q")
    for i, k in enumerate(keys):
        met = met & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = local.join(F.broadcast(carried), met, "left")  # one row a partition at most: the part of its first key
    given = {number: F.col("_n") + F.coalesce("_b", F.lit(0))} | {c: F.col(f"{s}r") + F.coalesce(f"{s}b", F.lit(0)) for s, c in zip(names, sums, strict=True)}
    return out.select(*df.columns, *[c.alias(n) for n, c in given.items()])
