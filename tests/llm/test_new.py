"""Operators 11 to 13 against plain code."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from quarrylark.llm import common, dedup, infill, ordermin, setjoin, trie

# ---------------------------------------------------------------- order MinHash

MASK = (1 << 64) - 1


def spread(h):
    h ^= h >> 32
    h = h * 0xFF51AFD7ED558CCD & MASK
    h ^= h >> 29
    return h * 0xD6E8FEB86659FD93 & MASK


def plain_fingerprint(text):
    """All elements under all permutations, in Python's integers."""
    steps = [int(x) for x in ordermin.STEPS]
    c = [ord(x) for x in text]
    c += [ordermin.FILL] * (ordermin.K - len(c))
    elements, seen = [], defaultdict(int)
    for i in range(len(c) - ordermin.K + 1):
        h, width, step = c[i : i + ordermin.K], 1, 0
        while width < ordermin.K:
            h = [(a * steps[step] + b) & MASK for a, b in zip(h, h[width:])]
            width, step = width * 2, step + 1
        kmer = spread(h[0]) >> 31 << 31
        elements.append((spread((kmer + seen[kmer] * steps[1]) & MASK) >> 32, i))
        seen[kmer] += 1
    out = []
    for p in range(ordermin.M):
        factor = int(ordermin.FACTORS[p // 2, 0])
        value = lambda x: x * factor & 0xFFFFFFFF if p % 2 == 0 else 0xFFFFFFFF - (x * factor & 0xFFFFFFFF)  # noqa: E731, B023
        least = sorted(elements, key=lambda e: value(e[0]))[: ordermin.L]
        h = steps[1] + len(least)
        for x, _ in sorted(least, key=lambda e: e[1]):
            h = spread((h * steps[2] + x) & MASK)
        out.append((h >> 32) & 0xFFFFFFFF)
    return out


def texts():
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdeé日😀") for _ in range(rnd.randrange(1, 9))) for _ in range(300)]
    some = [" ".join(rnd.choice(words) for _ in range(rnd.choice([1, 2, 30, 200]))) for _ in range(30)]
    return [*some, "", "a", "ab" * 40, "x" * 500, "short 日", some[3], some[3] + "!", "line\n" * 60]


def test_fingerprint_is_the_minimal_elements_in_order():
    for t in texts():
        assert ordermin.fingerprint(t).tolist() == plain_fingerprint(t), t


def test_short_and_empty_texts():
    f = ordermin.fingerprint
    assert ordermin.likeness(f(""), f("")) == 1 and ordermin.likeness(f(""), f("a")) == 0
    assert ordermin.likeness(f("abc"), f("abc")) == 1


def test_order_matters_where_sets_do_not():
    rnd = random.Random(3)
    parts = [" ".join("".join(rnd.choice("abcdefghij") for _ in range(7)) for _ in range(40)) for _ in range(6)]
    a, b = " ".join(parts), " ".join(parts[::-1])
    changed = a.replace(a[100:110], "XXXXXXXXXX")
    near, swapped = (ordermin.likeness(ordermin.fingerprint(a), ordermin.fingerprint(x)) for x in (changed, b))
    assert near > 0.7 and swapped < 0.75 and near > swapped


def expected_neighbours(rows):
    t = [x or "" for _, x in rows]
    out = []
    for i, (k, _) in enumerate(rows):
        following = t[(i + 1) % len(t)]
        n = len(t[i]) // 4
        e = t[i][: len(t[i]) - n] + following[:n]
        a, b, c = (ordermin.fingerprint(x) for x in (t[i], e, following))
        out.append((k, len(t[i]), hashlib.sha256(e.encode()).hexdigest(), ordermin.spelled(a), ordermin.spelled(b), float((a == b).mean()), float((a == c).mean())))
    return out


@pytest.mark.parametrize("split", ["true", "false"])
def test_neighbours(spark, tmp_path, split):
    rows = list(enumerate([*texts(), None, None]))
    shuffled = random.Random(1).sample(rows, len(rows))
    spark.createDataFrame([(*r, 1, "p") for r in shuffled], "doc_id long, text string, part int, key string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", split)
    try:
        got = sorted(map(tuple, ordermin.op11_order_minhash(spark, str(tmp_path)).collect()))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == expected_neighbours(rows)


def test_neighbours_of_few_rows(spark):
    kind = "doc_id long, text string"
    assert ordermin.edited_and_next(spark.createDataFrame([], kind)).count() == 0
    one = ordermin.edited_and_next(spark.createDataFrame([(3, "abcdefgh" * 5)], kind)).collect()
    assert [(r.key, r.near_next) for r in one] == [(3, 1.0)] and one[0].edited_sha256 == hashlib.sha256(("abcdefgh" * 5)[:30].encode() + b"abcdefghab").hexdigest()
    # null keys come first; rows repeated whole are each other's next
    rows = [(None, "first text of all, long enough")] + [(1, "the same text, long enough")] * 3
    got = ordermin.edited_and_next(spark.createDataFrame(rows, kind)).collect()
    assert sorted(r.near_next for r in got if r.key == 1) == [0.0, 1.0, 1.0] and [r.near_next for r in got if r.key is None] == [0.0]


# ---------------------------------------------------------------- fill in middle


def plain_infill(key, text):
    t = text or ""
    x = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(x[i : i + 8], 16) for i in (0, 8, 16, 24)]
    w = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
    n = len(w)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    digest = lambda y: hashlib.sha256(y.encode()).hexdigest()
    if not t or any(mark in t for mark in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return key, n, "plain", None, None, digest(t), digest(t)
    spm = h[3] % 100 < 20
    out = f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"
    return key, n, "spm" if spm else "psm", len(p), len(m), digest(out), digest(t)


def test_infill_is_plain_code(spark, tmp_path):
    odd = [None, "", " ", "<", "<<P", "a<P>b", "x <S> y", "<M>", "<P", "P>", "<<<>>><S", "Ab1é日😀\n\t\r\x0b", "abc" * 5000, "é" * 3000, "a1" * 2000, "<S" * 50, "[`{@Zz"]
    rows = [(i, t) for i, t in enumerate(odd * 25 + texts())] + [(None, "no key at all"), (7, "again"), (7, "again")]
    spark.createDataFrame([(*r, 5, "f") for r in rows], "doc_id long, text string, n int, form string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, infill.op12_infill(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted((plain_infill(*r) for r in rows), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_infill_restores_with_other_marks(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "doc_id long, text string")
    marks = ("(.", "|", "$1")
    found = infill.fill_in_middle(df, seed=9, rate=100, marks=marks)
    back = found.select("key", infill.restored(found["output"], found["form"], marks).alias("t"))
    assert sorted(map(tuple, back.collect())) == list(enumerate(texts()))
    assert infill.fill_in_middle(df.filter("doc_id < 0")).count() == 0


def test_select_finds_every_set_bit():
    rnd = random.Random(2)
    for width in (1, 2, 63, 64, 65, 1000):
        bits = rnd.getrandbits(width) | 1 << (width - 1)
        places = [i for i in range(width) if bits >> i & 1]
        assert [infill.select(bits, r) for r in range(len(places))] == places


# ---------------------------------------------------------------- prefix trie


def plain_trie(sequences, words):
    """All nodes as dictionaries of prefixes. sequences: conv to a list of turns."""
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(sequences):
        s = tuple(sequences[c])
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
        ends[s].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(members[p]) - 1) * words(p[-1]) if p else 0)
    digest = lambda p: hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()
    return sorted((m[0], len(p), members[p[:-1]][0] if p else -1, len(m), len(kids[p]), leaves[p], saved[p], digest(p)) for p, m in members.items())


def plain_rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        if c is not None:
            own[c].append((role or "", text or ""))
    heads = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    return {c: own.get(c - c % 20, [])[: heads[c]] + own[c][heads[c] :] for c in own}


def count(turn):
    return len(re.findall(r"[^\x20\x09-\x0d]+", turn[1]))


def check(got, want):
    assert sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got) == want


def conversations(rnd):
    """Shared openings, whole copies, a long conversation, some without base, null turns, roles and texts."""
    said = ["", "hello there", "a b c", "one two  three\tfour", "é 日本", None, "x" * 2000, "so be it"]
    rows = []
    for c in [*range(0, 45), *range(63, 80), 140, 201]:
        copy = random.Random(c % 5 if c % 3 == 0 else 1000 + c)
        for turn in range(copy.choice([1, 2, 3, 5, 7])):
            rows.append((c, turn, copy.choice(["user", "assistant", None]) if c % 7 == 0 else "user", copy.choice(said)))
    rows += [(60, i, "user", f"turn {i}") for i in range(300)] + [(5, None, "system", "before all"), (None, 0, "user", "nobody's"), (40, 3, None, None)]
    rnd.shuffle(rows)
    return rows


def test_trie_of_the_query(spark, tmp_path):
    rows = conversations(random.Random(4))
    # turns of one number have no order of their own: keep them apart here
    rows = list({(r[0], r[1]): r for r in rows}.values())
    spark.createDataFrame([(*r, 1, "c") for r in rows], "conv_id long, turn int, role string, text string, depth int, conv string").repartition(4).write.parquet(f"{tmp_path}/conversations.parquet")
    check(trie.op13_prefix_trie(spark, str(tmp_path)).collect(), plain_trie(plain_rebuilt(rows), count))


def as_frames(spark, sequences):
    import xxhash

    rows = []
    for c, s in sequences.items():
        total = 0
        for i, t in enumerate(s):
            total += count(t)
            rows.append((c, i, xxhash.xxh3_128_digest(repr(t).encode()), count(t), total))
    turns = spark.createDataFrame(rows, "conv long, pos long, token binary, words long, cum long")
    convs = spark.createDataFrame([(c, len(s), sum(map(count, s))) for c, s in sequences.items()], "conv long, len long, total long")
    return turns, convs


CASES = {
    "none": {},
    "one": {4: ["a", "b c"]},
    "turnless": {4: [], 9: []},
    "turnless and one": {4: [], 9: ["a"], 11: []},
    "equal": {i: ["a", "b c", "d"] for i in range(3, 30, 2)},
    "prefix of another": {1: ["a"], 2: ["a", "b"], 3: ["a", "b", "c c c"]},
    "late split": {1: ["x y"] * 40 + ["p"], 2: ["x y"] * 40 + ["q q"], 5: ["x y"] * 40},
    "two late splits": {1: ["x"] * 20 + ["p"] * 9, 2: ["x"] * 20 + ["q"], 3: ["y y"] * 31 + ["r"], 4: ["y y"] * 31, 8: ["y y"] * 31 + ["r"], 9: ["z"]},
}


@pytest.mark.parametrize("name", CASES)
def test_trie(spark, name):
    sequences = {c: [("user", t) for t in s] for c, s in CASES[name].items()}
    check(trie.prefix_trie(*as_frames(spark, sequences)).collect(), plain_trie(sequences, count))


def test_quiet_levels_are_passed_over(spark):
    sequences = {c: [("user", t) for t in s] for c, s in CASES["late split"].items()}
    turns, convs = as_frames(spark, sequences)
    _, found = trie.classes(turns, convs)
    levels = trie.descend(found, turns)
    assert [(d, u) for d, u, _ in levels] == [(0, 0), (1, 40), (41, 41)]


def test_members_of_many_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 7)
    sequences = {i: [("user", "a")] for i in [*range(95, 130), 1000, 7, -3]}
    check(trie.prefix_trie(*as_frames(spark, sequences)).collect(), plain_trie(sequences, count))


# ---------------------------------------------------------------- rows that aren't Parquet


@pytest.mark.parametrize("kind", ["json", "csv", "orc", "parquet"])
def test_rows_of_any_file(spark, tmp_path, kind):
    schema = "doc_id long, text string"
    rows = [(i, t) for i, t in enumerate(["a b c d e f", "A b c d e f", "x y z w v u", "x y z w v u", "alone here", "alone here too"])]
    spark.createDataFrame(rows, schema).repartition(2).write.format(kind).save(f"{tmp_path}/t")
    df = spark.read.schema(schema).format(kind).load(f"{tmp_path}/t")
    assert common.file_backed(df) == (kind == "parquet")
    assert sorted((r.key, r.keep_id) for r in dedup.exact_groups(df).collect()) == [(0, 1), (1, 1), (2, 3), (3, 3), (4, 4), (5, 5)]
    assert sorted(r.doc_id for r in dedup.survivors(df).collect()) == [1, 3, 4, 5]
    assert sorted(r.doc_id for r in setjoin.representatives(df, k=2, share=80).collect()) == [0, 2, 4, 5]
    assert len(ordermin.edited_and_next(df).collect()) == 6


def test_factors_are_odd_and_differ():
    f = ordermin.FACTORS.ravel()
    assert (f % 2 == 1).all() and len(np.unique(f)) == len(f)
