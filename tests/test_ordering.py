"""Running numbers and sums within keys against windows of Spark, with a key that holds most rows and spans partitions."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarrylark.operators import ordering
from quarrylark.operators.citations import bibtex_keys


@pytest.fixture
def spread(spark):
    """Small tables in as many partitions as shuffles have."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def table(spark):
    i = F.col("id")
    key = F.when(i % 3 != 0, F.lit("hot")).when(i % 33 == 0, F.lit(None)).otherwise(F.concat(F.lit("k"), (i % 7).cast("string")))
    return spark.range(5000).select(i, key.alias("key"), F.when(i % 5 != 0, F.hash("id")).alias("at"), F.when(i % 4 != 0, i % 11).alias("w"))


def test_running_within_is_a_window(spread):
    df = table(spread)
    order = [F.asc_nulls_first("at"), F.col("id")]
    w = Window.partitionBy("key").orderBy(*order)
    want = df.withColumns({"n": F.row_number().over(w), "total": F.coalesce(F.sum(F.coalesce("w", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))})
    got = ordering.running_within(df, ["key"], order, "n", {"total": F.col("w")})
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == sorted(map(tuple, want.collect()), key=lambda r: r[0])


def test_a_hot_key_lies_in_many_partitions(spread, monkeypatch):
    kept = []
    monkeypatch.setattr(ordering, "materialise", lambda df, name, f=ordering.materialise: kept.append(f(df, name)) or kept[-1])
    ordering.running_within(table(spread), ["key"], ["id"]).count()
    parts = {r[0]: r[1] for r in kept[0].filter("key = 'hot'").groupBy("_p").count().collect()}
    assert len(parts) >= 4 and max(parts.values()) < 1500


def test_running_within_two_keys_and_nothing(spread):
    df = spread.range(400).select("id", (F.col("id") % 2).alias("a"), F.lit(None).cast("string").alias("b"))
    got = ordering.running_within(df, ["a", "b"], [F.desc("id")], "place").collect()
    assert all(r.place == (399 - r.id) // 2 + 1 for r in got) and len(got) == 400
    assert ordering.running_within(df.filter("id < 0"), ["a"], ["id"]).count() == 0


def test_keys_of_one_base(spread):
    df = spread.range(300).select(F.col("id").cast("string").alias("uid"), F.lit("Smith J").alias("authors"), F.lit("2020").alias("year"), F.lit("A title").alias("title"), F.col("id").alias("k"))
    got = {int(r.uid): r.cite_key[len("smith2020a"):] for r in bibtex_keys(df, ["k"]).collect()}
    assert [got[i] for i in range(300)] == ["", *[chr(97 + min(i, 25)) for i in range(299)]]
