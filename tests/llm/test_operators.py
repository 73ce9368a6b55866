"""Small fixtures with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns; brute force beside them."""

import hashlib
import math
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarrylark.llm import common, dedup, html, lm, media, packing, pieces, quality, setjoin, sharding, tokencounts

TEXTS = ["The cat sat on the mat", "the CAT sat on the mat", None, "", " \n\t", "a b", "über straße 😀 日本", "w " * 5000, "x" * 70000, "The cat sat on the mat", "one two three four five six seven eight nine ten eleven twelve"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, "s" if i % 3 else None) for i, t in enumerate(TEXTS)]
    rows.append(rows[-1])  # a row repeated whole
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("key", F.lit("clash")).withColumn("shard", F.lit(1)).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def words(t):
    return lower(t).encode().split()


# ------------------------------------------------------------ language model


def kneser_ney(train, order):
    """Plain interpolated modified Kneser-Ney over word tuples: a function of a window."""
    counts = [Counter() for _ in range(order + 1)]
    for t in train:
        s = ["<s>"] * (order - 1) + t + ["</s>"]
        counts[order].update(tuple(s[i : i + order]) for i in range(len(s) - order + 1))
    for n in range(order - 1, 0, -1):
        for g, c in counts[n + 1].items():
            counts[n][g[1:]] += c if n > 1 and g[1] == "<s>" and False else (raw(counts, g, order) if n + 1 > 2 and g[1] == "<s>" else 1)
    d = []
    for n in range(1, order + 1):
        c = Counter(counts[n].values())
        if min(c[1], c[2], c[3], c[4]) == 0:
            d.append([0, 0.5, 1.0, 1.5])
        else:
            y = c[1] / (c[1] + 2 * c[2])
            d.append([0] + [min(max(k - (k + 1) * y * c[k + 1] / c[k], 0), k) for k in (1, 2, 3)])

    def p(w):
        out = 1 / (len(counts[1]) + 1)
        for n in range(1, order + 1):
            g = tuple(w[-n:])
            same = [c for h, c in counts[n].items() if h[:-1] == g[:-1]]
            if not same:
                continue
            a, total = counts[n][g], sum(same)
            gamma = sum(d[n - 1][min(c, 3)] for c in same) / total
            out = max(a - d[n - 1][min(a, 3)], 0) / total + gamma * out
        return out

    return p


def raw(counts, g, order):
    return counts[len(g)][g]


@pytest.mark.parametrize("order", [2])
def test_model_is_kneser_ney(spark, order):
    rnd = random.Random(4)
    voc = [f"w{i}" for i in range(12)]
    train = [[rnd.choice(voc[: rnd.choice([3, 12])]) for _ in range(rnd.randrange(0, 30))] for _ in range(60)]
    test = [*train[:5], ["w0", "new", "w1"], []]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(train)], "doc_id long, text string").repartition(4)
    model = lm.train(df, order)
    got = {r.doc_id: r for r in lm.score(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(test)], "doc_id long, text string"), model).collect()}
    p = kneser_ney(train, order)
    for i, t in enumerate(test):
        s = ["<s>"] * (order - 1) + t + ["</s>"]
        want = sum(math.log10(p(s[j : j + order])) for j in range(len(s) - order + 1))
        assert got[i].score == pytest.approx(want, abs=1e-9)
    assert model.sums[0]["raw"] == sum(len(t) + 1 for t in train)
    total = sum(p(["w0", w]) for w in [*voc, "</s>"]) + p(["w0", "never"])
    assert total == pytest.approx(1)


def test_model_of_order_three_is_kneser_ney(spark):
    rnd = random.Random(6)
    train = [[rnd.choice("abcdefgh"[: rnd.choice([3, 8])]) for _ in range(rnd.randrange(0, 30))] for _ in range(60)]
    test = [*train[:5], ["a", "new", "b", "a"], []]
    frame = lambda rows: spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r for r in lm.score(frame(test), lm.train(frame(train).repartition(4), 3)).collect()}
    p = kneser_ney(train, 3)
    for i, t in enumerate(test):
        s = ["<s>"] * 2 + t + ["</s>"]
        assert got[i].score == pytest.approx(sum(math.log10(p(s[j : j + 3])) for j in range(len(s) - 2)), abs=1e-9)


def test_model_of_order_three_sums_to_one(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a b c a b d", "a b c", "b c a"] * 3)], "doc_id long, text string")
    m = lm.train(df, 3)
    s = m.open()
    h = lambda t: lm.token_hashes(t.encode())
    every = [*(h(w)[0] for w in "abcd"), lm.END, np.uint64(99)]
    keys = np.array([[h("a")[0], h("b")[0], w] for w in every], np.uint64)
    assert s.probabilities(keys)[0].sum() == pytest.approx(1)


def test_score_edges(docs, none):
    m = lm.train(docs)
    got = lm.score(docs, m).collect()
    assert len(got) == len(TEXTS) + 1 and all(np.isfinite(r.score) and r.n_tokens >= 1 for r in got)
    assert lm.score(none, m).count() == 0
    assert [r.score for r in lm.score(docs.limit(1), lm.train(none)).collect()] == [0.0]


# ------------------------------------------------------------ media


def test_jpeg_round_trip():
    payloads = [media.padded((t or "").encode()) for t in TEXTS] + [media.padded(bytes(range(256)) * 1200)]
    for p, x in zip(payloads, media.read_media(media.write_images(payloads)), strict=True):
        assert x[2].tobytes() == p and len(p) % 576 == 0 and len(p) > 0
    assert media.write_images([]) == []


def reference_jpeg(blocks, ac):
    """A two-component image, interleaved 2x1 and 1x1, by a plain bit writer; luma DC in blocks."""
    dc, acs = media.codes_of(media.DC_LENGTHS, media.DC_SYMBOLS), media.codes_of([0, 2, 1, 0] + [0] * 12, [0, 0x01, 0x11])
    bits = ""

    def put(v, table):
        nonlocal bits
        n = abs(v).bit_length()
        c, k = table[n]
        bits += f"{c:0{k}b}" + (f"{v if v >= 0 else v + (1 << n) - 1:0{n}b}" if n else "")

    pred = [0, 0]
    for i in range(0, len(blocks), 2):
        for c, v in ((0, blocks[i]), (0, blocks[i + 1]), (1, i % 5)):
            put(v - pred[c], dc)
            pred[c] = v
            for s in ac:
                code, k = acs[s]
                bits += f"{code:0{k}b}" + "1" * (s & 15)
            code, k = acs[0]
            bits += f"{code:0{k}b}"
    bits += "1" * (-len(bits) % 8)
    data = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")
    n = len(blocks)
    frame = media.segment(0xC0, struct.pack(">BHHB", 8, 8, 8 * n, 2) + bytes([1, 0x21, 0, 2, 0x11, 0]))
    tables = media.segment(0xC4, bytes([0, *media.DC_LENGTHS, *media.DC_SYMBOLS])) + media.segment(0xC4, bytes([0x10, 0, 2, 1, 0, *[0] * 12, 0, 0x01, 0x11]))
    return media.HEAD + frame + tables + media.segment(0xDA, bytes([2, 1, 0, 2, 0, 0, 63, 0])) + data + b"\xff\xd9"


def test_general_jpeg_and_broken_media(spark):
    rnd = random.Random(2)
    blocks = [rnd.randrange(-120, 120) for _ in range(10)]
    good = reference_jpeg(blocks, [0x01, 0x11])
    w, h, t = media.read_media([good])[0]
    assert (w, h) == (80, 8) and t.tolist() == [[b + 128 for b in blocks]]
    rows = [(good,), (None,), (b"",), (good[:-9],), (b"GIF89a",), (good.replace(b"\xff\xc0", b"\xff\xc2"),)]
    got = media.describe(spark.createDataFrame(rows, "media binary").coalesce(1)).collect()
    assert got[0].width == 80 and got[0].error is None and got[1].error is None
    assert all(r.error and r.width is None for r in got[2:])


# ------------------------------------------------------------ token counts


def test_rollup(spark, docs):
    roll = tokencounts.Rollup(spark, common.shared_folder(spark, "t"))
    assert roll.totals().count() == 0
    first = tokencounts.counted(docs, "words-1")
    assert roll.apply("b1", first) and not roll.apply("b1", first)
    total = lambda: roll.totals().agg(F.sum("n_docs"), F.sum("n_tokens")).first()
    assert tuple(total()) == (len(TEXTS), sum(len(words(t)) for t in TEXTS))
    change = spark.createDataFrame([(0, "delete", None, None, "words-1", None), (1, "revise", None, None, "words-1", 100), (1, "revise", None, None, "words-1", 100), (99, "delete", None, None, "words-1", None)], "key long, op string, source string, lang string, version string, n_tokens long")
    roll.apply("b2", change)
    roll.apply("b2", change)
    assert tuple(total()) == (len(TEXTS) - 1, sum(len(words(t)) for t in TEXTS) - 6 - 6 + 100)
    assert {r.n_tokens for r in tokencounts.counted_bpe(docs.filter("doc_id = 2")).collect()} == {0}


CHANGES = "key long, op string, source string, lang string, version string, n_tokens long, seq long"


def plain_rollup(batches):
    """Totals by plain dictionaries."""
    live = {}
    for rows in batches:
        last = {}
        for key, op, source, lang, version, n, seq in rows:
            order = (seq is not None, seq or 0, op == "delete", n or 0, op, source is not None, source or "", lang is not None, lang or "")
            if (key, version) not in last or order > last[key, version][0]:
                last[key, version] = order, op, source, lang, n or 0
        for k, (_, op, source, lang, n) in last.items():
            old = live.pop(k, None)
            if op != "delete":
                s, lng = (source if source is not None else old[0], lang if lang is not None else old[1]) if op == "revise" and old else (source, lang)
                live[k] = s, lng, n
    out = defaultdict(lambda: [0, 0])
    for (_, version), (source, lang, n) in live.items():
        out[source, lang, version][0] += 1
        out[source, lang, version][1] += n
    return {k: tuple(v) for k, v in out.items()}


def test_rollup_of_many_batches(spark):
    """Null versions, order in a batch, and snapshots on the way, against plain dictionaries."""
    rnd = random.Random(5)
    some = lambda *x: rnd.choice(x)
    batches = [[(rnd.randrange(12), some("insert", "insert", "delete", "revise"), some("s", None), some("en", "de", None), some("v1", "v2", None), some(None, 1, 7, 50), some(None, 1, 2, 3)) for _ in range(rnd.randrange(0, 9))] for _ in range(7)]
    roll = tokencounts.Rollup(spark, common.shared_folder(spark, "t"), compact=3)
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, CHANGES)
        assert roll.apply(f"b{i}", df) and not roll.apply(f"b{i // 2}", df)
        got = {(r.source, r.lang, r.version): (r.n_docs, r.n_tokens) for r in roll.totals().collect()}
        assert got == plain_rollup(batches[: i + 1])
    assert roll.commits() == {f"b{i}" for i in range(7)}


def test_rollup_refuses_and_orders(spark):
    roll = tokencounts.Rollup(spark, common.shared_folder(spark, "t"))
    frame = lambda *rows: spark.createDataFrame(list(rows), CHANGES)
    roll.apply("a", frame((1, "insert", "s", "en", None, 5, None)))
    roll.apply("again", frame((1, "insert", "s", "en", None, 5, None)))
    assert [tuple(r)[3:] for r in roll.totals().collect()] == [(1, 5)]
    roll.apply("b", frame((1, "revise", None, None, None, 9, 1), (1, "delete", None, None, None, None, 2)))
    assert roll.totals().count() == 0
    for row in ((None, "insert", "s", "en", "v", 1, None), (1, "upsert", "s", "en", "v", 1, None), (1, None, "s", "en", "v", 1, None)):
        with pytest.raises(Exception):
            roll.apply("c", frame(row))
    assert roll.commits() == {"a", "again", "b"}


def test_rollup_batches_at_once(spark):
    """Another batch commits while one is at work: the later is done again on top of it."""
    folder = common.shared_folder(spark, "t")
    one, two = tokencounts.Rollup(spark, folder), tokencounts.Rollup(spark, folder)
    frame = lambda n: spark.createDataFrame([(1, "insert", "s", "en", "v", n, None)], CHANGES)
    write, calls = one._write, []

    def meanwhile(*args):
        write(*args)
        if not calls:
            calls.append(two.apply("other", frame(5)))

    one._write = meanwhile
    assert one.apply("mine", frame(8)) and calls == [True]
    assert [tuple(r) for r in one.totals().collect()] == [("s", "en", "v", 1, 8)]


# ------------------------------------------------------------ quality


def test_factorisation_identity():
    rng = np.random.default_rng(0)
    m = quality.Machine(0.1, rng.normal(size=quality.SIZE), rng.normal(size=(quality.SIZE, 3)))
    f = quality.Features()
    for t in (b"", b"a b a", "ü 1 !!".encode()):
        i, x = f.of(t)
        pairs = sum(m.v[i[a]] @ m.v[i[b]] * x[a] * x[b] for a in range(len(i)) for b in range(a))
        want = 1 / (1 + np.exp(-np.clip(0.1 + m.w[i] @ x + pairs, -30, 30)))
        assert m.score([(i, x)])[0] == pytest.approx(want)


def test_quality_held_out(spark):
    got = quality.op4_fm_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert (got.predicted == got.quality).mean() >= 0.97
    assert got.score.between(0, 1).all()


def test_quality_edges(spark, docs, none):
    m = quality.train(docs.withColumn("quality", F.lit(None).cast("int")))
    assert {r.score for r in quality.score(docs, m).collect()} == {0.5}
    assert quality.score(none, m).count() == 0


def test_pipeline_drops_what_the_classifier_rejects(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    machine = quality.train(quality.labelled_documents(docs, spark.read.parquet(f"{sf}/labels.parquet")))
    scores = {r.doc_id: r.score for r in quality.score(docs, machine).select("doc_id", "score").collect()}
    assert any(0.25 <= x < 0.5 for x in scores.values())
    assert {r.doc_id for r in corpus_pipeline.quality_stage(spark, docs, sf).collect()} == {k for k, x in scores.items() if x >= 0.5}


# ------------------------------------------------------------ html


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("plain &amp; text", "plain & text"),
    ("<nav><a href=x>m</a></nav><article><h1>T</h1><p>One  two<p>three<br>four<script>var a='</p>'</script></article><footer>f</footer>", "T\nOne two\nthree four"),
    ("<div class='sidebar'>s</div><div id=main><p>Long enough text of the article.</p><p>And more of it here, too.</p><form>q</form></div><section class='comments'><p>I say so</p></section>", "Long enough text of the article.\nAnd more of it here, too."),
])
def test_main_text(page, want):
    assert html.extract(page) == want


@pytest.mark.parametrize("box", ["article", "main", "div", "section"])
def test_main_text_beside_a_nested_body(box):
    body = [f"A long paragraph, number {i}, of the body with words enough to weigh much more than what stands beside it. " * 4 for i in range(12)]
    lead, end = ["Title", "Lead of it."], ["Thanks for reading.", "The end."]
    long = "".join(f"<p>{x}</p>" for x in body)
    page = f"<html><body><div><a href=a>Home</a> <a href=b>About</a></div><{box}><h1>{lead[0]}</h1><p>{lead[1]}</p><div class=body>{long}</div><p>{end[0]}</p><p>{end[1]}</p></{box}><footer>f</footer></body></html>"
    assert html.extract(page).split("\n") == [*lead, *[x.strip() for x in body], *end]


BODY = "A paragraph of the article with words enough to count as its content."


@pytest.mark.parametrize("name", ["content has-sidebar", "no-sidebar", "post category-social", "post share-enabled", "sidebar-right", "menu"])
@pytest.mark.parametrize("box", ["article", "div"])
def test_main_text_in_named_wrapper(name, box):
    page = f"<body><div class='site-footer'>Site</div><div class='{name}'><{box}><h1>T</h1><p>{BODY}</p><p>{BODY}</p></{box}><div class='sidebar-left'>s</div></div><div id='main-nav'><a href=x>m</a></div><div class='comments-area'>{BODY}</div></body>"
    assert html.extract(page) == f"T\n{BODY}\n{BODY}"


def test_main_text_part_with_a_compound_name():
    part = f"<p>{BODY}</p><p>{BODY}</p>"
    assert html.extract(f"<body><div>{part}</div><div class='part share-enabled'><p>{BODY}</p></div></body>") == "\n".join([BODY] * 3)


def test_main_text_beside_long_notices():
    assert html.extract(f"<div class=content><p>Brief note.</p></div><div class='cookie-notice'>{BODY * 9}</div><section id=comments>{BODY * 9}</section>") == "Brief note."
    assert html.extract(f"<article><p>Brief note.</p></article><div class=sidebar>{BODY * 9}</div>") == "Brief note."
    assert html.extract(f"<div class=widget>{BODY}</div><div class=widget>{BODY}</div>") == f"{BODY}\n{BODY}"


@pytest.mark.parametrize("start", ["<body>", "<p>", "<div>", ""])
def test_main_text_after_an_open_head(start):
    page = f"<html><head><meta charset=utf-8><title>T</title><style>p {{}}</style>\n<script>1</script>{start}{BODY}<p>{BODY}</p></html>"
    assert html.extract(page) == f"{BODY}\n{BODY}"


def test_main_text_of_links_alone():
    assert html.extract("<body><div><a href=a>one</a></div><div><a href=b>two</a></div></body>") == "one\ntwo"


def test_main_text_of_pages(spark):
    import re
    from html import unescape

    for r in html.op5_html_main_text(spark, "/root/testdata/sf0.001").join(spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


# Pages whose markup and names say nothing: div alone.
LONG = "The body of the page goes on for a while, with words enough in each of its paragraphs to weigh more than a link does."


def anonymous(rnd):
    """A page of unnamed boxes and the text in its content box."""
    links = lambda n: "".join(f"<div><a href=/{i}>{rnd.choice(['Home', 'About us', 'All of our archive', 'Contact'])}</a></div>" for i in range(n))
    paragraphs = [rnd.choice([LONG, LONG * 3, "Short one.", "It is so."]) for _ in range(rnd.randrange(4, 20))] + [LONG]
    boxed = "".join(f"<{t}>{x}</{t}>" for x in paragraphs for t in [rnd.choice(["p", "div", "blockquote"])])
    title = "A heading of the page"
    body = rnd.choice([f"<h1>{title}</h1>{boxed}", f"<h1>{title}</h1><div>{boxed}</div>", f"<div><h1>{title}</h1></div><div>{links(1)}</div><div><div>{boxed}</div></div>"])
    page = f"<html><body><div>{links(rnd.randrange(3, 9))}</div><div><div>{body}</div><div>{links(rnd.randrange(3, 12))}</div></div><div>{links(4)}<div>Made by someone, 2024</div></div></body></html>"
    return page, "\n".join([title, *paragraphs])


def test_main_text_of_unnamed_boxes_comes_from_ratio_smoothing_and_clusters(monkeypatch):
    rnd = random.Random(9)
    pages = [anonymous(rnd) for _ in range(120)]
    wrong = lambda: sum(html.extract(page) != want for page, want in pages)
    assert wrong() == 0
    with monkeypatch.context() as m:  # without the clustering
        m.setattr(html, "threshold", lambda x: float(x.min()))
        assert wrong() > 100
    with monkeypatch.context() as m:  # without the ratios
        m.setattr(html, "smooth", lambda x, sigma: np.ones(len(x)))
        assert wrong() > 100
    with monkeypatch.context() as m:  # without the Gaussian
        m.setattr(html, "smooth", lambda x, sigma: x)
        assert wrong() > 0


# ------------------------------------------------------------ pieces


def test_pieces():
    p = pieces.Pieces(pieces.model_path(None))
    rnd = random.Random(3)
    alphabet = ["the", " ", "  ", "\n", "é", "😀", "日", "x" * 90, "ing", "a", "Z", "▁"]
    for _ in range(200):
        t = "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(0, 25)))
        ids = p.encode(t)
        assert p.decode(ids) == t.replace("▁", " ")
        s = ((" " if t else "") + t).replace(" ", "▁")
        best = [(0.0, None)] + [None] * len(s)  # plain Viterbi over the whole text
        for e in range(1, len(s) + 1):
            for size in range(min(16, e), 0, -1):
                i = p.use.get(s[e - size : e])
                cost = p.score[i] if i is not None else p.worst if size == 1 else None
                if cost is not None and (best[e] is None or best[e - size][0] + cost > best[e][0]):
                    best[e] = (best[e - size][0] + cost, (e - size, -1 if i is None else i))
        want, e = [], len(s)
        while e:
            b, i = best[e][1]
            want = list(p.ids_of(i, s[b:e])) + want
            e = b
        assert ids == want
        cut = sorted(rnd.randrange(0, len(t) + 1) for _ in range(3))
        parts = [t[: cut[0]], t[cut[0] : cut[1]], t[cut[1] : cut[2]], t[cut[2] :]]
        assert [x for part in p.stream(parts) for x in part] == ids


def test_piece_stream_gives_ids_as_soon_as_all_paths_meet():
    """After every character: the ids given out are those before the boundary where all paths of the window meet."""
    p = pieces.Pieces(pieces.model_path(None))
    rnd = random.Random(8)
    text = "".join(rnd.choice(["there", "ing", "s", "qz", "é", "日", "0x", "international", "a"]) for _ in range(300)).replace(" ", "")
    s, out, links, best = pieces.Stream(p), [], [(0, 0)], [0.0]
    for e, c in enumerate(text, 1):
        out += s.feed(c)
        tries = [(best[e - n] + p.score[i], n, i) for n in range(min(p.longest, e), 0, -1) if (i := p.use.get(text[e - n : e])) is not None]
        tries += [(best[e - 1] + p.worst, 1, -1)] if c not in p.singles else []
        score, n, i = max(tries, key=lambda x: (x[0], x[1]))
        best.append(score)
        links.append((e - n, i))
        alive = set(range(max(0, e + 1 - p.longest), e + 1))
        while len(alive) > 1:  # plainly: follow the farthest back until one boundary is left
            top = max(alive)
            alive.remove(top)
            alive.add(links[top][0])
        (b,) = alive
        want = []
        while b:
            a, i = links[b]
            want = [*p.ids_of(i, text[a:b]), *want]
            b = a
        assert out == want
    assert 0 < len(out)
    e, rest = len(text), []
    while e:
        a, i = links[e]
        rest = [*p.ids_of(i, text[a:e]), *rest]
        e = a
    assert out + s.finish() == rest


def test_piece_stream_of_a_long_text_without_marks():
    p = pieces.Pieces(pieces.model_path(None))
    rnd = random.Random(9)
    text = "".join(rnd.choice(["a", "the", "日", "0", "qz"]) for _ in range(60_000))
    s = pieces.Stream(p)
    out, most = [], 0
    for a in range(0, len(text), 1000):
        out += s.feed(text[a : a + 1000])
        most = max(most, s.end - s.root)
    assert most < 20 * p.longest  # what is open stays near the window
    assert len(s.best) < 10_000 and p.decode([*out, *s.finish()]) == text


def test_pieces_of_a_batch(monkeypatch):
    """Words told apart by their ids: the same as each text through the window alone, whatever was in the memo and the batch."""
    p = pieces.Pieces(pieces.model_path(None))
    rnd = random.Random(10)
    alphabet = ["the", " ", " ", "  ", "\n", "é", "😀", "日", "\0", "x" * 90, "ing", "a", "Z", "▁", "qz", "\ufffd", ".", "0"]
    texts = ["".join(rnd.choices(alphabet, k=rnd.randrange(0, 40))) for _ in range(400)] + [None, "", " ", "   ", "▁", "a ", " a", "\n", "😀 😀"]
    want = [p.encode(t or "") for t in texts]
    for words, memo, slice_ in ((1 << 19, 250_000, 1 << 16), (7, 10, 5)):
        monkeypatch.setattr(pieces, "WORDS", words)
        monkeypatch.setattr(pieces, "MEMO", memo)
        monkeypatch.setattr(pieces, "SLICE", slice_)
        for _ in range(2):
            got = p.encode_all(pa.array(texts))
            assert got.to_pylist() == want
            assert p.decode_all(got) == [(t or "").replace("▁", " ") for t in texts]
        assert p.encode_all(pa.array([], pa.string())).to_pylist() == p.decode_all(p.encode_all(pa.array([], pa.string()))) == []
        p.memo, p.older = {}, {}
    p.prefix = False
    assert p.encode_all(pa.array(texts)).to_pylist() == [p.encode(t or "") for t in texts]
    p.cuts = False
    assert p.encode_all(pa.array(texts)).to_pylist() == [p.encode(t or "") for t in texts]


def test_piece_words_go_through_the_window_together(monkeypatch):
    """A batch's words cost one run through the window, and its ids come out where paths meet, not by closing the stream."""
    p = pieces.Pieces(pieces.model_path(None))
    rnd = random.Random(11)
    texts = [" ".join("".join(rnd.choices(["th", "in", "é", "qu", "er", "s,"], k=rnd.randrange(1, 6))) for _ in range(300)) for _ in range(20)]
    fed, closed = [], []
    feed, finish = pieces.Stream.feed, pieces.Stream.finish
    monkeypatch.setattr(pieces.Stream, "feed", lambda s, t: fed.append(feed(s, t)) or fed[-1])
    monkeypatch.setattr(pieces.Stream, "finish", lambda s: closed.append(finish(s)) or closed[-1])
    run = getattr(p, "encode_all", lambda a: [p.encode(t) for t in a.to_pylist()])
    run(pa.array(texts))
    assert len(fed) <= 3 and sum(map(len, closed)) <= 10 * len(closed) < 100
    assert sum(map(len, fed)) > 1000


def test_piece_decode_of_any_ids():
    p = pieces.Pieces(pieces.model_path(None))
    rnd = random.Random(12)
    of = {k: [i for i, x in enumerate(p.kind) if x == k] for k in set(p.kind)}
    rows = [[rnd.choice(of[rnd.choice(kinds)]) for _ in range(rnd.randrange(0, 12))] for kinds in ([*of], [1, 6], [1, 6, 2], [6]) for _ in range(200)]

    def plain(ids):
        out, raw = [], bytearray()
        for i in [*ids, None]:
            if i is not None and p.kind[i] == pieces.BYTE:
                raw.append(int(p.text[i][3:5], 16))
                continue
            out.append(raw.decode(errors="replace"))
            raw = bytearray()
            if i is not None and p.kind[i] != pieces.CONTROL:
                out.append(" ⁇ " if p.kind[i] == pieces.UNKNOWN else p.text[i])
        text = "".join(out).replace("▁", " ")
        return text[1:] if text.startswith(" ") else text

    want = [plain(x) for x in rows]
    assert [p.decode(x) for x in rows] == want == p.decode_all(pa.array(rows, pa.list_(pa.int32())))
    assert p.decode_all(pa.array(rows[200:], pa.list_(pa.int32()))) == want[200:]
    assert p.decode_all(pa.array(rows[200:], pa.list_(pa.int32())).slice(5, 9)) == want[205:214]


def test_piece_stream_whose_paths_do_not_meet(monkeypatch):
    """Runs of one character: paths of different phase go on beside each other; followed back seldom, ids are the same."""
    p = pieces.Pieces(pieces.model_path(None))
    text = "z" * 3001 + "the" + "-" * 5000 + "é" * 999
    whole = pieces.Stream(p)
    want = whole.feed(text) + whole.finish()
    monkeypatch.setattr(pieces, "OFTEN", 20)
    for n in (1, 7, 1000):
        s = pieces.Stream(p)
        assert [i for a in range(0, len(text), n) for i in s.feed(text[a : a + n])] + s.finish() == want
    assert p.decode(want) == text


def test_pieces_frames(docs, none):
    enc = pieces.encoded(docs)
    back = {r.doc_id: r.text for r in pieces.decoded(enc).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    assert pieces.encoded(none).count() == 0


# ------------------------------------------------------------ set join


@pytest.mark.parametrize("k, share, long", [(4, 85, 8192), (5, 80, 8192), (4, 85, 5)])
def test_set_join(spark, docs, none, k, share, long, monkeypatch):
    monkeypatch.setattr(setjoin, "LIST", long)  # at 5 the lists are led in pieces
    rnd = random.Random(k)
    voc = [f"w{i}" for i in range(2000)]
    rows = [(1000 + i, t) for i, t in enumerate(TEXTS)]
    passage = [rnd.choice(voc) for _ in range(50)]
    for b in range(8):
        base = [rnd.choice(voc) for _ in range(rnd.choice([3, 8, 30, 100]))]
        for _ in range(rnd.choice([2, 12, 40])):
            w = list(base)
            for _ in range(rnd.choice([0, 1, 2, 4])):
                w[rnd.randrange(len(w))] = rnd.choice(voc)
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + i, " ".join(passage + [rnd.choice(voc) for _ in range(rnd.randrange(12))])) for i in range(60)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in setjoin.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), k=k, share=share).collect()}
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[j : j + k]) for j in range(len(w) - k + 1)])
    to = {i: i for i in sets}

    def find(a):
        while to[a] != a:
            a = to[a]
        return a

    ids = list(sets)
    for x in range(len(ids)):
        for y in range(x):
            a, b = sets[ids[x]], sets[ids[y]]
            o = len(a & b)
            if o and 100 * o >= share * (len(a) + len(b) - o):
                p, q = find(ids[x]), find(ids[y])
                to[max(p, q)] = min(p, q)
    assert got == {i: (len(sets[i]), find(i)) for i in sets}


def test_set_join_edges(docs, none):
    got = setjoin.near_duplicates(docs).collect()
    assert len(got) == len(TEXTS) + 1
    assert setjoin.near_duplicates(none).count() == 0


def test_set_join_without_keys(spark):
    rows = [(3, "a b c d e"), (None, "a b c d e"), (None, "x y z w v u"), (None, "x y z w v u"), (1, "A b c d e"), (None, None)]
    got = setjoin.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, got)) == Counter([(3, 2, 1), (1, 2, 1), (None, 2, None), (None, 3, None), (None, 3, None), (None, 0, None)])


# ------------------------------------------------------------ exact dedup


def test_rice_codes():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000):
        v = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        assert (dedup.rice_decode(dedup.rice_encode(v, 0, 1 << 64), 0) == v).all()


def test_exact_groups(docs, none):
    got = dedup.exact_groups(docs).collect()
    groups = defaultdict(list)
    for i, t in [*enumerate(TEXTS), (len(TEXTS) - 1, TEXTS[-1])]:
        groups[lower(t)].append(i)
    assert len(got) == len(TEXTS) + 1
    for r in got:
        own = groups[lower(TEXTS[r.key])]
        assert (r.keep_id, r.group_size, r.kept, r.sha) == (max(own), len(own), r.key == max(own), hashlib.sha256(lower(TEXTS[r.key]).encode()).hexdigest())
    assert dedup.exact_groups(none).count() == 0


# ------------------------------------------------------------ packing


def test_fullest_is_exact():
    rnd = random.Random(5)
    for _ in range(100):
        lengths = [rnd.randrange(1, 30) for _ in range(rnd.randrange(1, 12))]
        room = rnd.randrange(1, 60)
        sums = {0}
        for x in lengths:
            sums |= {s + x for s in sums if s + x <= room}
        got = packing.fullest(np.bincount(lengths, minlength=room + 1), room, min(lengths))
        assert sum(got) == max(sums) and not Counter(got) - Counter(lengths)


def test_packing(docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.best_fit(packing.pieces(docs)).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.key].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    for i, t in enumerate(TEXTS[:-1]):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert sum(r.length for r in own) == len(ids)
        for r in own:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) and (r.piece == 0 or r.length == 2048)
    for rows in by_seq.values():
        at = 0
        for o, n in sorted(rows):
            assert o == at
            at += n
        assert at <= 2048
    assert len(by_seq) == -(-sum(r.length for r in got) // 2048)
    assert packing.best_fit(packing.pieces(none)).count() == 0


@pytest.mark.parametrize("refused", [False, True])
def test_added_tokens_in_text(monkeypatch, refused):
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    def fail(*_, **__):
        raise ValueError

    if refused:
        monkeypatch.setattr(tiktoken.Encoding, "encode", fail)
        monkeypatch.setattr(tiktoken.Encoding, "encode_ordinary", fail)
    ids, tok, mark = packing.encoder(), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), "<|endoftext|>"
    assert ids(f"one document{mark}the next") == [505, 3188, 50256, 1169, 1306]
    for t in (mark, mark * 3, f"a  {mark}  b", f"\n\n{mark}\n\n", f"<|endoftext|{mark}|>", f"x{mark}'s {mark}", mark[:-1], mark.upper(), f"é {mark}日本", "no mark  "):
        assert ids(t) == tok.encode(t, add_special_tokens=False).ids


# ------------------------------------------------------------ sharding


def test_shards(spark, docs, none):
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.repeat(F.lit("w "), (F.col("id") % 37).cast("int")), (F.col("id") % 900).cast("string")).alias("text"))
    got = sharding.slots(sharding.vector_shards(many)).toPandas()
    assert len(got) == 3000 and got.groupby("gid").shard.nunique().max() == 1
    sizes = got.groupby("shard")["size"].sum()
    assert len(sizes) == 16 and sizes.max() / sizes.min() < 1.05
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    odd = sharding.slots(sharding.vector_shards(docs)).collect()
    assert len(odd) == len(TEXTS) + 1 and {r["size"] for r in odd if r["key"] in (2, 3)} == {1}
    assert sharding.slots(sharding.vector_shards(none)).count() == 0
