"""Searches of the index against a scan of the texts."""

import random

import pytest
from pyspark.sql import functions as F

from quarrylark.operators import postings as P


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rnd = random.Random(2)
    words = ["Alpha", "beta", "alphabet", "gamma-ray", "É", "日本", "x,y", "common"] + [f"w{i}" for i in range(300)]
    rows = [(rnd.randrange(-3, 40) << 11 | i, " ".join(["common", *(rnd.choice(words) for _ in range(rnd.randrange(12)))]), rnd.choice(["t\tu", None, "", "Alpha\nbeta"])) for i in range(400)]
    rows += [(None, "common w1", ""), (7, None, None), (8, "", ""), (rows[0][0], "again common beta", "")]
    where = str(tmp_path_factory.mktemp("postings"))
    df = spark.createDataFrame(rows, "doc long, a string, b string")
    P.build(df, where, "doc", ["a", "b"], buckets=8)
    return where, rows


@pytest.mark.parametrize("words", ["common", "alpha", "alpha beta", "BETA common w1", "a", "日本 é", "x,y", "gamma- ray", "t u", "none such", "common none", "  ", "beta beta"])
def test_search_is_a_scan(spark, index, words):
    where, rows = index
    wanted = words.lower().split()
    want = set()
    # repeated keys are one row of all their terms
    joined = {}
    for k, a, b in rows:
        if k is not None:
            joined[k] = joined.get(k, "") + f"\n{a or ''} {b or ''}".lower()
    want = {k for k, t in joined.items() if t.split() and all(w in t for w in wanted)}
    got = [r.key for r in P.search(spark, where, words).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_only_matching_postings_are_read(spark, index):
    where, _ = index
    plan = P.search(spark, where, "gamma-ray w77")._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.split("FileScan")[1:] if "/postings/rows" in x.split("PartitionFilters")[0] or "places" in x.split("]")[0]]
    assert scans and all("term IN (gamma-ray" in x or "In(term, [gamma-ray" in x for x in scans) and all("bucket" in x.split("PartitionFilters: [")[1].split("]")[0] for x in scans)


def test_a_term_of_all_rows_is_many_short_rows(spark, tmp_path):
    P.build(spark.range(30_000).select("id", F.lit("all the same").alias("t")), str(tmp_path), "id", ["t"], buckets=4)
    sizes = [r[0] for r in spark.read.parquet(f"{tmp_path}/postings/rows").select(F.size("places")).collect()]
    assert max(sizes) <= 1 << P.BITS and P.search(spark, str(tmp_path), "same all").count() == 30_000
