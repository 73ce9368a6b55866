"""Links of texts and snapshots of a catalogue."""

import pytest
from pyspark.sql import functions as F

from quarrylark.operators import links as L
from quarrylark.operators import snapshots as P


def test_links(spark):
    text = "Code at https://github.com/a/B.git, see (http://www.site.org/x). github.com/a/issues/tree and https://osf.io/abchttps://x.y doi https://doi.org/10.1000/x"
    docs = spark.createDataFrame([("u", text), ("v", None), ("w", "")], "uid string, text string")
    got = L.classified(L.extract(docs, "uid", "text"))
    assert {(r.url, r.kind) for r in got.collect()} == {("https://github.com/a/B", "github"), ("https://site.org/x", "website"), ("https://github.com/a", "github-user"), ("https://osf.io/abc", "osf")}
    both = got.withColumn("where", F.lit("fulltext")).unionByName(got.withColumn("where", F.lit("abstract")))
    rows = L.paper_links(both).collect()
    assert len(rows) == 3 and {r.where for r in rows} == {"abstract"}
    far = spark.createDataFrame([("u", "x" * 300 + " https://github.com/a/b " + "y " * 100)], "uid string, text string")
    assert L.extract(far, "uid", "text").first().context == "x" * 119 + " https://github.com/a/b " + ("y " * 40).strip()


def test_dois(spark):
    lines = spark.createDataFrame([("f", "see 10.1000/A, and (10.1000/b). 10.1000/a"), ("g", "none")], "file string, line string")
    assert sorted((r.file, r.doi) for r in L.text_dois(lines, ["file"]).collect()) == [("f", "10.1000/a"), ("f", "10.1000/b")]


def test_snapshots(spark, tmp_path):
    root = str(tmp_path)
    df = spark.createDataFrame([("a", "2024-01-01", "")], "uid string, added_on string, status string")
    assert P.read(spark, root) is None and P.commit(df, root, 0) == 1
    again = P.read(spark, root).withColumn("status", F.lit("x"))
    assert P.commit(again, root, 1) == 2 and P.read(spark, root).first().status == "x"
    with pytest.raises(RuntimeError):
        P.commit(df, root, 1)
    assert P.run_row(df, "2024-01-01", "2024-02-01").first().rows_added == 1
    assert P.day_changes(df, df.withColumn("status", F.lit("new"))).collect()[0].status == "new"
