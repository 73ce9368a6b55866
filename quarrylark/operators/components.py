"""Connected components and roots of pointers over tables of longs, in rounds of joins, each written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylark.storage import materialise


def _checksum(df: DataFrame, *columns: str) -> tuple:
    return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*columns).cast("decimal(38,0)"))).first())


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b) over longs: node and component, its smallest node. Isolated nodes aren't listed.

    Alternates the large-star and small-star steps, each a grouped minimum and a join; hot nodes are pre-aggregated by
    the minimum and split by adaptive skew joins. Every step is written to the shared folder. Null ends and loops are no edges.
    """
    now = materialise(edges.select("a", "b").filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionByName(now.join(least, "a").filter("m < a").select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        now = materialise(small.filter("a <> b").distinct(), "edges")
        got = _checksum(now, "a", "b")
        if got == seen:
            break
        seen = got
    else:
        raise RuntimeError("components didn't settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def roots(pointers: DataFrame, rounds: int = 60) -> DataFrame:
    """node and root, where pointers (node, parent) lead to a smaller node each; nodes that point nowhere aren't listed.

    Every round each node takes its parent's parent, so that a chain of n pointers needs log2(n) rounds.
    """
    now = materialise(pointers.select("node", "parent"), "pointers")
    seen = None
    for _ in range(rounds):
        up = now.select(F.col("node").alias("parent"), F.col("parent").alias("_up"))
        now = materialise(now.join(up, "parent", "left").select("node", F.coalesce("_up", "parent").alias("parent")), "pointers")
        got = _checksum(now, "node", "parent")
        if got == seen:
            return now.select("node", F.col("parent").alias("root"))
        seen = got
    raise RuntimeError("pointers didn't settle")
