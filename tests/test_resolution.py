"""In-batch resolution against plain loops over records in order."""

import random

import pytest
from pyspark.sql import functions as F

from quarrylark.operators import catalogue as C
from quarrylark.operators import resolution as R
from quarrylark.operators.components import connected, roots

KIND = "uid string, n int, keys array<string>"


def batch(seed, n=120, hot=False):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        keys = [f"k{rnd.randrange(n)}" for _ in range(rnd.choice([0, 1, 1, 2, 3]))]
        if hot and i % 3 == 0:
            keys.insert(rnd.randrange(len(keys) + 1), "hot")
        rows.append((f"u{rnd.randrange(n * 9 // 10)}", i, keys if rnd.random() < 0.95 else None))
    return rows


def linked(rows, aliases):
    names = list(range(len(rows)))

    def find(i):
        while names[i] != i:
            i = names[i]
        return i

    first = {}
    for i, (uid, _, keys) in enumerate(rows):
        for k in [uid, *(keys or [])]:
            a, b = find(first.setdefault(k, i)), find(i)
            names[max(a, b)] = min(a, b)
    stored = {}
    for i, (uid, _, keys) in enumerate(rows):
        for k in [uid, *(keys or [])]:
            if k in aliases:
                stored.setdefault(find(i), aliases[k])
    return [stored.get(find(i), rows[find(i)][0]) for i in range(len(rows))]


def in_order(rows, aliases):
    known, out = dict(aliases), []
    for uid, _, keys in rows:
        every = [uid, *(keys or [])]
        name = next((known[k] for k in every if k in known), uid)
        for k in every:
            known.setdefault(k, name)
        out.append(name)
    return out


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("with_aliases", [False, True])
def test_batches(spark, hot, with_aliases):
    rows = batch(7 + hot, hot=hot)
    aliases = {f"k{i}": f"s{i % 4}" for i in range(0, 120, 9)} if with_aliases else {}
    df = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), KIND)
    known = spark.createDataFrame(list(aliases.items()), "alias string, target string") if with_aliases else None
    for function, plain in ((R.resolve_linked, linked), (R.resolve_in_order, in_order)):
        got = {r.n: (r.uid, r.keys, r.resolved) for r in function(df, ["n"], known).collect()}
        assert [got[i] for i in range(len(rows))] == [(u, k, name) for (u, _, k), name in zip(rows, plain(rows, aliases), strict=True)], function.__name__


def test_what_bridges_two_works(spark):
    rows = [("a", 0, ["d1"]), ("b", 1, ["p2"]), ("c", 2, ["d1", "p2"]), ("d", 3, ["p2"])]
    df = spark.createDataFrame(rows, KIND)
    assert [r.resolved for r in R.resolve_in_order(df, ["n"]).orderBy("n").collect()] == ["a", "b", "a", "b"]
    assert [r.resolved for r in R.resolve_linked(df, ["n"]).orderBy("n").collect()] == ["a"] * 4


def test_empty_batch_and_next_batch(spark):
    empty = spark.createDataFrame([], KIND)
    assert R.resolve_linked(empty, ["n"]).count() == 0 == R.resolve_in_order(empty, ["n"]).count()
    first = R.resolve_linked(spark.createDataFrame([("a", 0, ["x"]), ("b", 1, ["x", "y"])], KIND), ["n"])
    known = R.new_aliases(first)
    assert sorted(map(tuple, known.collect())) == [("a", "a"), ("b", "a"), ("x", "a"), ("y", "a")]
    second = R.resolve_linked(spark.createDataFrame([("c", 0, ["z", "y"]), ("d", 1, ["z"])], KIND), ["n"], known)
    assert [r.resolved for r in second.orderBy("n").collect()] == ["a", "a"]
    assert R.new_aliases(second, known).filter("alias = 'z'").first().target == "a"


def test_chains_settle(spark):
    chain = spark.range(1, 400).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    assert [tuple(r) for r in connected(chain).groupBy("component").count().collect()] == [(0, 400)]
    got = roots(chain.select(F.col("a").alias("node"), F.col("b").alias("parent")))
    assert got.count() == 399 and got.filter("root <> 0").count() == 0


def test_merge_of_resolved_records(spark):
    rows = [("a", 1, ["s2", "s1"], 3, "", "x"), ("a", 2, ["s1"], 9, "n2", ""), ("a", 3, None, None, None, "y"), ("b", 1, [], 1, "", "")]
    df = spark.createDataFrame(rows, "uid string, n int, sources array<string>, cited int, newest string, oldest string")
    got = {r.uid: r for r in C.merge_fields(df, "uid", "n", ["sources"], ["cited"], ["newest"], ["oldest"]).collect()}
    assert (got["a"].sources, got["a"].cited, got["a"].newest, got["a"].oldest) == (["s1", "s2"], 9, "n2", "x")
    assert (got["b"].sources, got["b"].cited, got["b"].newest) == ([], 1, None)
