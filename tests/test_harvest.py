"""The harvest source: windows and words reach the service, offsets move, nothing is lost or doubled."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quarrylark.sources import harvest as H
from quarrylark.sources.io import write_text

START = dt.date(2024, 1, 1)


def day(n):
    return (START + dt.timedelta(days=n)).isoformat()


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    """Three rows a day for 90 days; a row is indexed up to nine days late."""
    where = str(tmp_path_factory.mktemp("harvest"))
    rows = [(f"w{i}", day(i // 3), f"Alpha beta{i % 4} gamma {'phrase here' if i % 5 == 0 else 'here phrase'}", f"v{i}", day(i // 3 + i % 10)) for i in range(270)]
    spark.createDataFrame(rows, "id string, day string, text string, value string, indexed string").write.parquet(f"{where}/rows")
    return where, rows


def asked(df):
    return df._jdf.queryExecution().executedPlan().toString()


def read(spark, staged, **options):
    return spark.read.format("harvest").options(staged=f"{staged[0]}/rows", cap="20", **options).load()


def ask(spark, staged, test=None, **options):
    return H.ask(spark, test, staged=f"{staged[0]}/rows", cap="20", **options)


@pytest.mark.parametrize("push", [True, False])
def test_filters_give_the_same_rows(spark, staged, push):
    H.register(spark)
    df = ask(spark, staged) if push else read(spark, staged)  # one relation for all conditions
    cases = [
        ((F.col("day") >= day(10)) & (F.col("day") < day(20)), lambda r: day(10) <= r[1] < day(20)), (F.col("day") == day(3), lambda r: r[1] == day(3)), ((F.col("day") > day(80)), lambda r: r[1] > day(80)),
        (F.col("day") >= "2024-02", lambda r: r[1] >= "2024-02"), (F.col("text").contains("a beta1 gamma phrase h"), lambda r: "a beta1 gamma phrase h" in r[2]), ((F.col("day") <= day(1)) | (F.col("id") == "w200"), lambda r: r[1] <= day(1) or r[0] == "w200"),
        (F.col("day") > day(500), lambda r: False),
    ]
    for test, plain in cases:
        got = df.filter(test)
        assert sorted(map(tuple, got.collect())) == sorted(r[:4] for r in staged[1] if plain(r))


def test_windows_are_pushed_and_words_tested_again(spark, staged):
    H.register(spark)
    df = ask(spark, staged)
    window = ask(spark, staged, (F.col("day") >= day(10)) & (F.col("day") < day(20)))
    assert "(day" not in asked(window).replace("isnotnull(day", "") and window.rdd.getNumPartitions() == 2 < df.rdd.getNumPartitions()
    words = df.filter(F.col("text").contains("a beta1 gamma phrase h"))
    assert "Contains(text" in asked(words) and words.rdd.getNumPartitions() < df.rdd.getNumPartitions()
    reader = H._Batch({"staged": f"{staged[0]}/rows"})
    left = list(reader.pushFilters([H.GreaterThan(("day",), day(4)), H.LessThan(("day",), day(9)), H.EqualTo(("id",), "x"), H.StringContains(("text",), "one two three"), H.LessThan(("day",), "2024")]))
    assert (reader.lo, reader.hi, reader.words) == (day(5), day(8), ["two"]) and [type(f).__name__ for f in left] == ["EqualTo", "StringContains", "LessThan"]


def test_newest_and_columns(spark, staged):
    H.register(spark)
    newest = sorted(staged[1], key=lambda r: (r[1], ), reverse=True)
    got = read(spark, staged, most="31", columns="id,day").collect()
    assert len(got) == 31 and {r.text for r in got} == {None}
    assert sorted(r.day for r in got) == sorted(r[1] for r in newest[:31]) and len({r.id for r in got}) == 31
    assert read(spark, staged, most="0").count() == 0 and read(spark, staged, most="9999").count() == 270
    assert read(spark, staged, query="beta2").count() == sum("beta2" in r[2] for r in staged[1])


def test_three_runs_lose_and_double_nothing(spark, staged, tmp_path):
    H.register(spark)
    clock, out = f"{tmp_path}/clock", f"{tmp_path}/out"
    seen = []
    for today in (day(30), day(45), day(45), day(200)):
        write_text(spark, clock, today)
        stream = spark.readStream.format("harvest").options(staged=f"{staged[0]}/rows", clock=clock, cap="50", overlap="14", **{"from": day(5)}).load()
        q = H.once(stream).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").start(out)
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        # a window of one's own reads what it asks for and moves no offset
        assert read(spark, staged, **{"from": day(0), "to": day(3)}).count() == 12
        ids = [r.id for r in spark.read.parquet(out).select("id").collect()]
        assert len(ids) == len(set(ids))
        seen.append(set(ids))
    want = lambda today: {r[0] for r in staged[1] if day(5) <= r[1] <= today and r[4] <= today}
    assert seen == [want(day(30)), want(day(45)), want(day(45)), want(day(200))]
