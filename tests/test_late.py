"""Texts joined late: the scan opens only what is left, and results are those of a plain join."""

import pytest
from pyspark.sql import functions as F

from quarrylark.operators import catalogue as C
from quarrylark.operators import texts as X


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("late")) + "/texts"
    X.write_texts(spark.range(500).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("uid"), F.concat(F.lit("text of "), F.col("id").cast("string")).alias("fulltext")), where, buckets=16)
    return where


def scan(df):
    """Partition and pushed filters of the texts' scan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    own = next(x for x in plan.split("FileScan")[1:] if "late" in x.split("PartitionFilters")[0] and "fulltext" in x.split("]")[0])
    return tuple(own.split(f"{k}: [")[1].split("], ")[0] for k in ("PartitionFilters", "PushedFilters"))


def keys(spark, ids):
    return spark.createDataFrame([(f"u{i}", i) for i in ids], "uid string, n int")


def test_few_keys_reach_the_scan(spark, folder):
    df = X.join_late(keys(spark, [3, 77, 499, 1000]), folder)
    buckets, pushed = scan(df)
    assert "bucket" in buckets and "In(uid, [" in pushed
    assert sorted(map(tuple, df.select("uid", "n", "fulltext").collect())) == [("u3", 3, "text of 3"), ("u499", 499, "text of 499"), ("u77", 77, "text of 77")]


def test_many_keys_open_their_buckets(spark, folder):
    df = X.join_late(keys(spark, range(0, 500, 2)), folder, few=10)
    assert "In(uid" not in scan(df)[1] and df.count() == 250
    some = X.join_late(keys(spark, [3, 77, 499]), folder, few=0)
    assert "bucket" in scan(some)[0] and some.count() == 3


def test_nothing_left_repeated_and_null_keys(spark, folder):
    assert X.join_late(keys(spark, []), folder).count() == 0
    rows = spark.createDataFrame([("u1", 1), ("u1", 2), (None, 3)], "uid string, n int")
    assert sorted(r.n for r in X.join_late(rows, folder).collect()) == [1, 2]


def test_select_with_late_texts(spark, folder):
    df = spark.createDataFrame([(f"u{i}", "core" if i % 2 else "related", "p.md" if i % 3 else "") for i in range(600)], "uid string, tier string, fulltext_md string")
    got = C.select(df, tier="core", fulltext="of .*7$", texts=folder)
    assert sorted(int(r.uid[1:]) for r in got.collect()) == [i for i in range(500) if i % 2 and i % 3 and i % 10 == 7]


def test_summaries_are_made_for_what_is_left(spark):
    seen = []
    df = spark.createDataFrame([("a", "core"), ("b", "related"), ("c", "core")], "uid string, tier string")

    def summarise(kept):
        seen.extend(sorted(r.uid for r in kept.collect()))
        return kept.withColumns({"summary": F.concat(F.lit("about "), "uid"), "keywords": F.lit("")})

    assert [r.uid for r in C.select(df, tier="core", summary="about c", summarise=summarise).collect()] == ["c"] and seen == ["a", "c"]
    with pytest.raises(ValueError):
        C.select(df, summary="x")
    own = df.withColumns({"summary": F.lit("mine"), "keywords": F.lit("")})
    assert C.select(own, summary="mine", summarise=lambda kept: 1 / 0).count() == 3


def test_context_has_both_sides(spark):
    text = "a" * 100 + " <" + "match" * 5 + "> " + "b" * 100
    got = spark.range(1).select(C.context(F.lit(text), "<(match)+>").alias("c"), C.context(F.lit("x <match> y"), "<(match)+>").alias("d"), C.context(F.lit("none"), "<m").alias("e")).first()
    assert tuple(got) == ("a" * 79 + " <" + "match" * 5 + "> " + "b" * 79, "x <match> y", None)


@pytest.mark.parametrize(("limit", "want"), [(-1, [0, 1, 2, 3]), (-5, []), (-9, []), (2, [0, 1]), (0, [0, 1, 2, 3, 4])])
def test_limits(spark, limit, want):
    df = spark.range(5).select(F.col("id").cast("string").alias("uid"), (9 - F.col("id")).cast("string").alias("cited_by"))
    assert [int(r.uid) for r in C.select(df, sort="cited_by", limit=limit).collect()] == want
