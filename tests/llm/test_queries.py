"""The registered queries and the pipeline's stages, run over a folder of small tables, against plain code or SQL."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from quarrylark.llm import lm, packing, pieces, quality, queries, setjoin, sharding
from tests.llm.test_operators import kneser_ney, lower, words

FIELDS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    """Copies, near copies, one source with a third of the rows, long, empty and null texts."""
    rnd = random.Random(11)
    voc = [f"{a}{b}{c}" for a in "bcdflmnprst" for b in "aeiou" for c in ("", "ng", "r", "st")]
    line = lambda n: " ".join(rnd.choice(voc) for _ in range(n))
    texts = [line(rnd.choice([3, 8, 40, 120])) + rnd.choice([".", "!\n" + line(5)]) for _ in range(150)]
    texts += [rnd.choice(texts).upper() if rnd.random() < 0.5 else rnd.choice(texts) for _ in range(20)]
    for _ in range(25):
        w = rnd.choice([t for t in texts if len(t) > 300]).split(" ")
        w[rnd.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [None, "", " ", "one", "one", "é ß 日本 😀 ▁", "x" * 9000, line(6000), "a <|endoftext|> b", "!!! $$$ ### | % " * 30]
    return [(i, t, "en", "big" if i % 3 == 0 else f"s{i % 7}", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, FIELDS).repartition(3).write.parquet(f"{d}/documents.parquet")
    labels = [(i, int("$" not in (t or "") and "!" not in (t or "")), int(i % 11 == 0)) for i, t, *_ in rows if i % 2]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def run(spark, folder, name):
    got = queries.QUERIES[name](spark, folder).collect()
    return got


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_is_its_sql(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    cur = con.execute(queries.ORACLES[name])
    names = [c[0] for c in cur.description]
    want = Counter(map(repr, cur.fetchall()))
    got = queries.QUERIES[name](spark, folder).select(*names).collect()
    assert Counter(repr(tuple(r)) for r in got) == want


def test_op1(spark, folder, rows):
    train = [words(t) for i, t, *_ in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    p, count = kneser_ney(train, 2), Counter(w for t in train for w in [*t, "</s>"])
    n, v = sum(count.values()), len(count)
    got = {r.doc_id: r for r in run(spark, folder, "op1_lm_score")}
    assert len(got) == len(rows)
    for i, t, *_ in rows[::4]:  # plain probabilities are slow
        s, r = ["<s>", *words(t), "</s>"], got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 5 == 1, len(s) - 1, sum(count[w] > 0 for w in s[1:]), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in s[1:]))
        if len(s) < 200:
            assert r.score == pytest.approx(sum(math.log10(p(s[j : j + 2])) for j in range(len(s) - 1)), abs=1e-8)


def test_op1_closes_what_it_used_longest_ago(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"w{i} w{i % 7} again") for i in range(60)], "doc_id long, text string")
    m = lm.train(df)
    want = {r.doc_id: r.score for r in lm.score(df, m).collect()}
    s = m.open()
    monkeypatch.setattr(lm, "MAPS", 3)
    for i in range(60):
        t = lm.token_hashes(f"w{i} w{i % 7} again".encode())
        assert np.log10(s.probabilities(lm.windows([t], 2))[0]).sum() == pytest.approx(want[i])
        assert len(s.shards) <= 3


@pytest.mark.parametrize("order", [2, 3])
def test_op1_by_groups_of_owners(spark, rows, monkeypatch, order):
    df = spark.createDataFrame([(i, t) for i, t, *_ in rows], "doc_id long, text string").repartition(5)
    want = {r.doc_id: r.score for r in lm.score(df, lm.train(df, order)).collect()}
    monkeypatch.setattr(lm, "WIDE", 3)
    got = {r.doc_id: r.score for r in lm.score(df, lm.train(df, order)).collect()}
    assert got == pytest.approx(want)


def test_shared_folder(monkeypatch):
    """Where no folder is named: a temporary one for a local session, an error on a cluster."""
    from types import SimpleNamespace as N

    from quarrylark.llm import common

    def session(master, conf=None, checkpoint=None):
        context = N(master=master, applicationId=master, getConf=lambda: N(get=lambda k, d=None: None), getCheckpointDir=lambda: checkpoint)
        return N(conf=N(get=lambda k, d=None: conf), sparkContext=context)

    assert common.shared_root(session("local[2]", "file:///x/")) == "file:///x"
    assert common.shared_root(session("yarn", None, "hdfs://n/c")) == "hdfs://n/c"
    own = common.shared_root(session("local[2]"))
    assert own.startswith("file://") and common.shared_root(session("local[2]")) == own
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.shared_root(session(master))


def test_marks(spark, tmp_path):
    from quarrylark.llm import common

    spark.range(0, 5000, 1, 3).selectExpr("id AS doc_id", "repeat('x', 50) AS text", "id % 7 AS cell").drop("cell").write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    at = common.located(docs)
    assert common.file_backed(docs) and not common.file_backed(docs.distinct())
    folder = common.mark(at.filter("doc_id % 5 = 0 AND doc_id < 3000").select("cell", "place"), "m")
    assert sorted(r.doc_id for r in at.filter(common.marked(folder)).collect()) == list(range(0, 3000, 5))
    assert at.filter(~common.marked(folder)).count() == 4400
    none = common.mark(at.limit(0).select("cell", "place"), "m")
    assert at.filter(common.marked(none)).count() == 0


def test_op2(spark, folder, rows):
    got = {r.doc_id: r for r in run(spark, folder, "op2_jpeg_media")}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        b = (t or "").encode()
        payload = b + b"\xff" * (max(1, -(-len(b) // 576)) * 576 - len(b))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    same = defaultdict(set)
    for i, t, *_ in rows:
        same[t or ""].add((got[i].media_bytes, got[i].media_sha256, got[i].feature))
    assert all(len(x) == 1 for x in same.values())


def test_op4_and_quality_stage(spark, folder, rows):
    got = {r.doc_id: r for r in run(spark, folder, "op4_fm_quality")}
    assert len(got) == len(rows) and all(r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got.values())
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    machine = quality.train(quality.labelled_documents(docs, spark.read.parquet(f"{folder}/labels.parquet")))
    f = quality.Features()
    for i, t, *_ in rows:  # one by one, with the pairs summed plainly
        index, x = f.of((t or "").encode())
        if len(index) < 150:
            v = machine.v[index] * x[:, None]
            pairs = sum(float(v[a] @ v[b]) for a in range(len(x)) for b in range(a))
            assert got[i].score == pytest.approx(1 / (1 + math.exp(-(machine.w0 + float(machine.w[index] @ x) + pairs))), abs=1e-5)
    kept = corpus_pipeline.quality_stage(spark, docs, folder).collect()
    assert sorted(r.doc_id for r in kept) == sorted(i for i, r in got.items() if r.score >= 0.5) and len(kept) < len(rows)


def best_pieces(p, text):
    s = ((" " if text and p.prefix else "") + text).replace(" ", "▁")
    best = [(0.0, None)] + [None] * len(s)
    for e in range(1, len(s) + 1):
        for size in range(min(p.longest, e), 0, -1):
            i = p.use.get(s[e - size : e])
            cost = p.score[i] if i is not None else p.worst if size == 1 else None
            if cost is not None and (best[e] is None or best[e - size][0] + cost > best[e][0]):
                best[e] = (best[e - size][0] + cost, (e - size, -1 if i is None else i))
    out, e = [], len(s)
    while e:
        b, i = best[e][1]
        out = [*p.ids_of(i, s[b:e]), *out]
        e = b
    return out


def test_op6(spark, folder, rows):
    p = pieces.Pieces(pieces.model_path(None))
    got = {r.doc_id: r for r in run(spark, folder, "op6_piece_codec")}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        t = t or ""
        r = got[i]
        assert r.exact and r.n_bytes == len(t.encode()) and r.decoded_sha256 == hashlib.sha256(t.replace("▁", " ").encode()).hexdigest()
        if len(t) < 2000:
            ids = best_pieces(p, t)
            assert (r.n_ids, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def tokens(rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t, *_ in rows}


def assert_packed(got, ids):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    assert by_doc.keys() == ids.keys()
    for i, own in by_doc.items():
        own.sort(key=lambda r: r.piece)
        at = 0
        for k, r in enumerate(own):
            assert (r.piece, r.start) == (k, at) and (k == 0 or r.length == 2048)
            assert r.ids_crc32 == zlib.crc32(ids[i][at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids[i])
    for own in by_seq.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 2048
    assert len(by_seq) == -(-sum(map(len, ids.values())) // 2048)  # the least there can be


def test_op9(spark, folder, rows):
    assert_packed(run(spark, folder, "op9_best_fit"), tokens(rows))


def test_bins_are_of_least_slack():
    """Each bin in turn: the longest piece left, and of all combinations of the others one of the largest sum."""
    rnd = random.Random(3)
    for _ in range(40):
        lengths = np.array([rnd.randrange(1, 60) for _ in range(rnd.randrange(1, 12))])
        left = sorted(lengths.tolist())
        for rows in packing.pack_lengths(lengths, 64):
            own = sorted(lengths[rows].tolist())
            first = left.pop()
            sums = {0}
            for x in left:
                sums |= {s + x for s in sums if s + x <= 64 - first}
            assert first in own and sum(own) == first + max(sums)
            own.remove(first)
            for x in own:
                left.remove(x)
        assert not left


def test_op10(spark, folder, rows):
    got = {r.doc_id: r for r in run(spark, folder, "op10_vector_shards")}
    assert len(got) == len(rows)
    shards, slots = defaultdict(set), defaultdict(list)
    for i, t, *_ in rows:
        r = got[i]
        b = (t or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(b) + 1, zlib.crc32(b), "bytes", None)
        shards[t or ""].add(r.shard)
        slots[r.shard].append(r.slot)
    assert all(len(x) == 1 for x in shards.values()) and all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_groups_go_where_the_dot_product_is_highest():
    rnd = np.random.default_rng(4)
    v, room = rnd.random((200, 3)) / 100, np.full((16, 3), 1 / 16)
    got, left = sharding.place(v, room.copy()), room.copy()
    for x, s in zip(v, got, strict=True):
        fits = [k for k in range(16) if left[k, 0] >= x[0]]
        best = max(fits, key=lambda k: (sum(a * b for a, b in zip(x, left[k], strict=True)), -k)) if fits else int(np.argmax(left[:, 0]))
        assert s == best
        left[s] -= x


# ------------------------------------------------------------ the pipeline

ODD = [  # id, text: repeated ids with other texts, null ids, rows repeated whole
    (5, "A text that is here twice"), (9, "B another text of some words"), (5, "B another text of some words"), (None, "a null id and a text"), (None, "A null id and a TEXT"),
    (None, "its only row"), (7, None), (8, ""), (8, ""), (3, "one two three four five six seven eight nine ten eleven twelve"), (4, "one two three four five six seven eight nine ten eleven twelve end"),
    (4, "quite another text under an id that is taken, of more words than that"), (2, "quite another text under an id that is taken, of more words than that"), (6, "w " * 3000), (6, "w " * 3000),
]


@pytest.fixture(scope="module")
def odd(spark):
    found = spark.createDataFrame([(i, t, "en", "s", len(t or ""), k, k) for k, (i, t) in enumerate(ODD)], FIELDS + ", cell long, key long")
    return found.repartition(3)


def test_exact_stage(spark, odd):
    got = sorted((lower(r.text), r.doc_id if r.doc_id is not None else -1) for r in corpus_pipeline.exact_stage(spark, odd, "").collect())
    best = {}
    for i, t in ODD:
        best[lower(t)] = max(best.get(lower(t), -1), -1 if i is None else i)
    assert got == sorted(best.items())
    assert corpus_pipeline.exact_stage(spark, odd, "").columns == odd.columns
    assert corpus_pipeline.exact_stage(spark, odd.limit(0), "").count() == 0


def test_near_stage(spark, odd):
    left = corpus_pipeline.near_stage(spark, odd, "")
    assert left.columns == odd.columns
    got = Counter((r.doc_id, r.text) for r in left.collect())
    want = Counter(ODD)
    want[3, ODD[9][1]], want[4, ODD[10][1]] = 1, 0  # 8 shingles against 9
    want[5, ODD[2][1]], want[9, ODD[1][1]] = 1, 0  # equal sets: the smallest id
    want[4, ODD[11][1]], want[2, ODD[12][1]] = 0, 1
    want[6, ODD[13][1]] = 1
    assert got == +want  # without words or id: linked with nothing
    assert corpus_pipeline.near_stage(spark, odd.limit(0), "").count() == 0


def test_set_join_of_repeated_keys(spark, odd):
    got = Counter(map(tuple, setjoin.near_duplicates(odd, k=5, share=80).collect()))
    size = lambda t, k=5: 0 if not words(t) else max(1, len({tuple(words(t)[i : i + k]) for i in range(len(words(t)) - k + 1)}))
    comp = {**{i: i for i, _ in ODD}}
    want = Counter()
    for n, (i, t) in enumerate(ODD):
        c = {1: 5, 2: 5, 10: 3, 11: 2, 12: 2}.get(n, comp[i])
        want[i, size(t), c] += 1
    assert got == want


def test_pack_stage(spark, odd):
    got = corpus_pipeline.pack_stage(spark, odd, "").collect()
    ids = [len(tokens([(0, t)])[0]) for _, t in ODD]
    assert sum(r.length for r in got) == sum(ids) and len(got) == sum(-(-n // 2048) for n in ids)
    assert corpus_pipeline.pack_stage(spark, odd.limit(0), "").count() == 0


def test_pipeline(spark, folder, rows):
    """All stages one after the other, and the whole run, against plain code."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    scores = {r.doc_id: r.score for r in run(spark, folder, "op4_fm_quality")}
    left = [(i, t) for i, t, *_ in rows if scores[i] >= 0.5]
    last = {lower(t): i for i, t in left}
    left = [(i, t) for i, t in left if last[lower(t)] == i]
    sets = {}
    for i, t in left:
        w = words(t)
        sets[i] = frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[j : j + 5]) for j in range(len(w) - 4)])
    to = {i: i for i, _ in left}

    def find(a):
        while to[a] != a:
            a = to[a]
        return a

    for i in to:
        for j in to:
            o = len(sets[i] & sets[j])
            if j < i and o and 100 * o >= 80 * len(sets[i] | sets[j]):
                to[max(find(i), find(j))] = min(find(i), find(j))
    left = [(i, t) for i, t in left if find(i) == i]
    got = corpus_pipeline.run(spark, folder).collect()
    assert_packed(got, tokens(left))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "packing"]
    assert corpus_pipeline.quality_stage(spark, docs.limit(0), folder).count() == 0
