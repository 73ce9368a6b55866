"""One ordered file from many tasks, byte for byte."""

import csv
import io
import json
import os

import pytest
from pyspark.sql import functions as F

from quarrylark.operators import citations as R
from quarrylark.sources import onefile as O
from quarrylark.sources.io import csv_text


@pytest.fixture
def spread(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def rows(spark, n):
    return spark.range(n).select("id", F.when(F.col("id") % 7 == 0, None).otherwise(F.repeat(F.concat(F.lit("é日"), F.col("id").cast("string")), (F.col("id") % 9).cast("int"))).alias("t"))


def texts(n):
    return ["" if i % 7 == 0 else f"é日{i}" * (i % 9) for i in range(n)]


@pytest.mark.parametrize("between", ["\n", "", "\r\n", ",\n"])
def test_bytes(spread, tmp_path, between):
    path = f"file:{tmp_path}/d/out.txt"
    for n in (0, 1, 5, 3000):
        got = O.write_file(rows(spread, n).orderBy(F.rand(3)), path, ["id"], F.col("t"), between, "<é", "é>\n", "none")
        want = ("<é" + between.join(texts(n)) + "é>\n" if n else "none").encode()
        with open(f"{tmp_path}/d/out.txt", "rb") as f:
            assert f.read() == want and got == len(want)
    assert os.listdir(f"{tmp_path}/d") in (["out.txt"], [".out.txt.crc", "out.txt"], ["out.txt", ".out.txt.crc"])


def test_files_of_another_store_are_joined(spread, tmp_path, monkeypatch):
    monkeypatch.setattr(O, "posix", lambda path: None)
    for n in (1, 3000):
        want = ("head\n" + ";;\n".join(texts(n)) + "\ntail").encode()
        assert O.write_file(rows(spread, n), f"file://{tmp_path}/out.txt", [F.desc("id") if n == 0 else "id"], F.col("t"), ";;\n", "head\n", "\ntail") == len(want)
        with open(f"{tmp_path}/out.txt", "rb") as f:
            assert f.read() == want
    assert not [x for x in os.listdir(tmp_path) if x.endswith(".parts")]


def test_a_lost_task_leaves_nothing(spread, tmp_path):
    bad = rows(spread, 500).withColumn("t", F.col("t"))
    lines = O._sorted(bad, ["id"], F.col("t"))
    at, _, size = O.placed(lines, "\n", "")
    temp, path = f"{tmp_path}/temp", f"{tmp_path}/out"
    spread.dataSource.register(O.Bytes)
    with open(temp, "wb") as f:
        f.truncate(size)
    with pytest.raises(Exception):  # noqa: B017  the task's error, as Spark wraps it
        at.withColumn("bytes", F.when(F.col("at") > 900, F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.col("bytes"))).write.format("bytes_at").mode("append").options(temp=temp, path=path, size=str(size)).save()
    assert os.listdir(tmp_path) == []


def test_csv_is_pythons(spread, tmp_path):
    values = ["x,y", 'q"q', " lead", "l1\nl2", None, "", "cr\rhere", "plain", "é"]
    data = [(i, values[i % 9], values[i * 5 % 9]) for i in range(200)]
    df = spread.createDataFrame(data, "id int, a string, `b,c` string")
    O.write_csv_file(df, f"{tmp_path}/all.csv", ["id"])
    with open(f"{tmp_path}/all.csv", newline="") as f:
        assert f.read() == csv_text(["id", "a", "b,c"], [{"id": i, "a": a, "b,c": b} for i, a, b in data])
    one = spread.createDataFrame([(1, ""), (2, "x"), (3, None)], "id int, a string")
    out = io.StringIO()
    csv.writer(out).writerows([["a"], [""], ["x"], [""]])
    spread.conf.set("spark.sql.adaptive.enabled", "true")
    O.write_file(one, f"{tmp_path}/one.csv", ["id"], O.csv_line(["a"]), "\r\n", "a\r\n", "\r\n")
    with open(f"{tmp_path}/one.csv", newline="") as f:
        assert f.read() == out.getvalue()


@pytest.mark.parametrize("code", ["VAN", "BIB", "CSL"])
def test_reference_files(spread, tmp_path, code):
    df = spread.range(60).select(F.concat(F.lit("u"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("uid"), F.lit("Doe J, Roe A").alias("authors"), F.lit("2020").alias("year"), F.concat(F.lit('A "title" é\n'), F.col("id").cast("string")).alias("title"), F.lit("article").alias("resource_type"))
    (path,) = R.write_references(df, [code], f"{tmp_path}/list", ["uid"])
    lines = [r.text for r in R.render(df, code, ["uid"]).orderBy("n").collect()]
    want = json.dumps([json.loads(x) for x in lines], indent=2, ensure_ascii=False, sort_keys=True) + "\n" if code == "CSL" else R.separator(code).join(lines) + "\n"
    with open(path) as f:
        assert f.read() == want
    (path,) = R.write_references(df.limit(0), [code], f"{tmp_path}/none.x", ["uid"])
    with open(path) as f:
        assert path.endswith("none.x") and f.read() == ("[]\n" if code == "CSL" else "")


def test_neighbouring_rows_are_written_at_once(tmp_path):
    """Runs of rows that follow each other, a gap, an empty text and a sliced batch; the time is that of the bytes."""
    import time

    import pyarrow as pa

    texts = [b"%06d;" % i for i in range(200_000)]
    places = [i * 7 for i in range(200_000)]
    batch = lambda at, b: pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(b, pa.binary())], ["at", "bytes"])
    temp, path = str(tmp_path / "t"), str(tmp_path / "f")
    open(temp, "wb").close()
    w = O._Writer(temp, path, 1_400_000)
    began = time.process_time()
    done = w.write(iter([batch(places[150_000:], texts[150_000:]), batch([], []), batch(places[:10] + [70] + places[10:100_000], texts[:10] + [b""] + texts[10:100_000]), batch(places, texts).slice(100_000, 50_000)]))
    assert done.n == 1_400_000 and time.process_time() - began < 1
    w.commit([done])
    assert open(path, "rb").read() == b"".join(texts)


def test_rows_that_are_placed_are_not_sorted_again(spark, tmp_path):
    from quarrylark.operators.ordering import running_number

    df = spark.range(1000, numPartitions=4).selectExpr("cast(id * 7919 % 1000 as string) AS t").repartition(5)
    rows = running_number(df, ["t"], "n", parts=True)
    size = O.write_file(rows, str(tmp_path / "f"), None, rows["t"], ", ", "<", ">")
    text = (tmp_path / "f").read_text()
    assert text == "<" + ", ".join(sorted(map(str, range(1000)))) + ">" and size == len(text)
