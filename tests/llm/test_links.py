"""Links between sets and their numbers against brute force."""

import random

import pytest

from quarrylark.llm import setjoin
from tests.llm.test_queries import corpus


def sets(text, k):
    w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def near_copies():
    """A group of near copies of which some link and some don't, equal sets, texts without words."""
    rnd = random.Random(3)
    base = [f"w{rnd.randrange(500)}" for _ in range(120)]
    out = []
    for i in range(60):
        w = list(base)
        for _ in range(i % 6):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(99)}"
        out.append(" ".join(w))
    return out + out[:5] + ["", None, "  ", "one two", "ONE two", "a b c d"]


@pytest.mark.parametrize("long_lists", [False, True])
@pytest.mark.parametrize("which", ["corpus", "near copies"])
def test_links(spark, monkeypatch, which, long_lists):
    if long_lists:
        monkeypatch.setattr(setjoin, "LIST", 4)
    rows = [(r[0], r[1]) for r in corpus()] if which == "corpus" else list(enumerate(near_copies()))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found, members = setjoin.links(df)
    own = {i: sets(t, 4) for i, t in rows}
    rep = {}
    for i, _ in rows:
        if own[i]:
            rep.setdefault(own[i], i)
    reps = sorted(rep.values())
    near = lambda x, y: 100 * len(x & y) >= 85 * len(x | y)
    want = {(a, b, len(own[a]), len(own[b]), len(own[a] & own[b])) for i, a in enumerate(reps) for b in reps[i + 1 :] if near(own[a], own[b])}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {r.key: r.rep for r in members.collect()} == {i: rep.get(own[i]) for i, _ in rows}
    counts = {r.doc_id: r.n_links for r in setjoin.link_counts(df).collect()}
    assert counts == {i: sum(1 for j, _ in rows if j != i and own[i] and own[j] and near(own[i], own[j])) for i, _ in rows}
