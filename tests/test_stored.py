"""Merges into the stored table against the plain merge, and what they read, shuffle and rewrite."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from quarrylark.operators import catalogue as C
from quarrylark.operators import stored as T

DAYS = ["2024-05-01", "2024-05-02", "2024-05-03"]


def rows(spark, ids, title="t"):
    i = F.col("id")
    text = lambda *c: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in c])
    df = spark.createDataFrame([(x,) for x in ids], "id long")
    return df.select(text("u", i).alias("uid"), text(title, i).alias("title"), F.lit("").alias("notes"), F.lit("").alias("status"))


@pytest.fixture
def table(spark, tmp_path):
    name = "stored_" + uuid.uuid4().hex[:8]
    first = rows(spark, range(300)).select("uid", "title", F.lit(DAYS[0]).alias("added_on"), F.concat(F.lit("by hand "), "uid").alias("notes"), "status")
    T.create(first, name, f"{tmp_path}/t", slices=8, buckets=4)
    yield name, first, f"{tmp_path}/t"
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def same(a, b):
    return sorted(map(tuple, a.select(sorted(a.columns)).collect())) == sorted(map(tuple, b.select(sorted(b.columns)).collect()))


def test_two_merges_are_the_plain_ones(spark, table):
    name, first, _ = table
    one = rows(spark, range(50, 350))
    two = rows(spark, range(100, 360), "new title ")
    want = C.merge_catalogue(C.merge_catalogue(first, one, DAYS[1]), two, DAYS[2])
    T.merge(spark, name, one, DAYS[1])
    T.merge(spark, name, two, DAYS[2])
    assert same(T.read(spark, name), want)
    assert T.merge(spark, name, two, "2024-06-01") == [] and same(T.read(spark, name), want)


def files(path):
    return {os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.startswith("part-")}


def test_only_touched_slices_are_rewritten(spark, table):
    name, first, path = table
    before = files(path)
    complete = rows(spark, range(300)).withColumn("title", F.when(F.col("uid") == "u7", "other").otherwise(F.col("title")))
    which = T.merge(spark, name, complete, DAYS[1])
    gone = {f for f in before - files(path)}
    assert len(which) == 1 and gone and all(f"slice={which[0]}/" in f for f in gone)
    assert {f for f in before if f"slice={which[0]}/" not in f} <= files(path)
    got = {r.uid: r for r in T.read(spark, name).collect()}
    assert len(got) == 300 and got["u7"].title == "other" and got["u7"].notes == "by hand u7" and got["u7"].added_on == DAYS[0]


def test_a_part_leaves_the_rest(spark, table):
    name, _, _ = table
    T.merge(spark, name, rows(spark, [5, 900], "x"), DAYS[1], complete=False)
    got = {r.uid: r for r in T.read(spark, name).collect()}
    assert len(got) == 301 and got["u5"].title == "x5" and got["u900"].added_on == DAYS[1] and {r.status for r in got.values()} == {""}
    T.merge(spark, name, rows(spark, [5]), DAYS[2])  # everything else is flagged
    T.merge(spark, name, rows(spark, [6], "y"), DAYS[2], complete=False)
    got = {r.uid: r for r in T.read(spark, name).collect()}
    assert got["u6"].status == "" and got["u5"].status == "" and sum(r.status == T.FLAG for r in got.values()) == 299


def test_the_stored_side_is_not_shuffled(spark, table):
    name, _, _ = table
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        stored = spark.table(name)
        columns = ["uid", "title", "added_on", "notes", "status"]
        laid = T._laid(rows(spark, range(300)).withColumn("added_on", F.lit("")).select(columns), columns, 8)
        for df in (T._merged(stored, laid, columns, [1, 2], DAYS[1], True, T.FLAG, 8), T.touched(stored, laid, columns).select("slice")):
            plan = df._jdf.queryExecution().executedPlan().toString()
            scan = plan.split("FileScan")[0].rsplit("SortMergeJoin", 1)[1]  # from the join down to its first child's scan
            assert "Exchange" not in scan and "Bucketed: true" in plan.split("FileScan")[1]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_another_session_attaches(spark, table):
    name, first, path = table
    other = name + "_again"
    T.attach(spark, other, path, "uid STRING, title STRING, added_on STRING, notes STRING, status STRING", slices=8, buckets=4)
    try:
        assert same(T.read(spark, other), first)
        assert len(T.merge(spark, other, rows(spark, range(1, 300)), DAYS[1])) == 1
    finally:
        spark.sql(f"DROP TABLE {other}")
