"""The one-pass matcher against one regular expression a name, as the rules state them."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from quarrylark.operators import matching as M


def plain(vocabulary, text):
    """Python's own search, one name after another."""
    out = []
    for name, p in vocabulary.items():
        loose = p.startswith("(?i)")
        starts = [m.start() for m in re.finditer(rf"(?<![\w-])(?:{p.removeprefix('(?i)')})(?![\w-])", text or "", re.I if loose else 0)]
        if starts:
            out.append((name, starts[0], len(starts)))
    return out


VOCABULARY = {
    "Horvath": "Horvath|DNAmAge", "horvath any": "(?i)horvath|dnamage", "two words": "Pan Tissue", "c++": r"c\+\+", "of": "(?i)of", "hyphen": "p-value", "digits": "(?i)GSE[0-9]+", "class": r"[Cc]lock",
    "é": "(?i)école|ÉTAT", "日本": "日本", "nested": "Pan", "dot": r"U\.S", "overlap": "a a",
}
TEXTS = [
    "Horvath and DNAmAge, HORVATH's; dnamage-x pre-Horvath _Horvath Horvath.", "Pan Tissue of Pan Tissues; PAN", "c++ xc++ c++- (c++)", None, "", "p-value p-values GSE12 gse3 GSEx", "Clock clock Clocks o'clock",
    "École état ÉTAT-x école", "日本 は 日本語", "U.S and U.S. of U-S", "a a a a", "İ Horvath İİ dnamage", "x" * 5000 + " of " + "Of" * 3, "of\nOF\tof",
]


def test_literal_forms():
    assert M.literal_forms("a b|c") == ["a b", "c"] and M.literal_forms(r"c\+\+") == ["c++"]
    assert M.literal_forms("a|") is None and M.literal_forms(r"\d") is None and M.literal_forms("a?") is None and M.literal_forms("(a)") is None


def test_is_one_regex_a_name(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    got = df.select("id", M.occurrences(F.col("text"), VOCABULARY).alias("m")).orderBy("id").collect()
    for r in got:
        assert [tuple(x) for x in r.m] == plain(VOCABULARY, TEXTS[r.id]), TEXTS[r.id]


def test_random_texts():
    rnd = random.Random(6)
    letters = "abAB -_é"
    for _ in range(60):
        forms = {f"n{i}": ("(?i)" if rnd.random() < 0.5 else "") + "|".join(re.escape("".join(rnd.choice("abAé ") for _ in range(rnd.randrange(1, 4))).strip() or "a") for _ in range(rnd.randrange(1, 3))) for i in range(6)}
        text = "".join(rnd.choice(letters) for _ in range(60))
        m = M.Matcher(forms.items())
        assert [(a, b) for a, b, _ in m.find(text)] == [(a, b) for a, b, _ in plain(forms, text)], (forms, text)


def test_slices_and_mistakes(spark, monkeypatch):
    monkeypatch.setattr(M, "SLICE", 3)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    got = df.select("id", M.labels(F.col("text"), VOCABULARY).alias("m")).orderBy("id").collect()
    assert [r.m for r in got] == [[n for n, *_ in plain(VOCABULARY, t)] for t in TEXTS]
    assert df.select(M.occurrences(F.col("text"), {}).alias("m")).first().m == []
    for bad in ("", "(?i)", "(a"):
        with pytest.raises(ValueError):
            M.occurrences(F.col("text"), {"x": bad})
    with pytest.raises(ValueError):
        M.vocabulary_of(spark.range(5).select(F.col("id").cast("string").alias("name"), F.lit("a").alias("pattern")), most=4)


def test_first_appearance(spark):
    v = {"AB": "AB", "A": "A", "none": "zz"}
    rows = [("u1", "", "AB first", "AB"), ("u2", "2001", "A and AB", "AB; A"), ("u3", "2001", "AB", "AB"), ("u4", "2000", "nothing", "A"), ("u5", None, "A", None)]
    df = spark.createDataFrame(rows, "uid string, date string, title string, entities string")
    got = sorted(map(tuple, M.first_appearance(df, v).select("name", "date", "uid", "papers").collect()))
    assert got == [("A", "2001", "u2", 4), ("AB", "2001", "u2", 3)]


def test_time_hardly_grows_with_the_names():
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(7))
    text = " ".join(word() for _ in range(60_000))

    def took(n):
        m = M.Matcher([(f"n{i}", word()) for i in range(n)])
        best = 9e9
        for _ in range(3):
            began = time.process_time()
            m.find(text)
            best = min(best, time.process_time() - began)
        return best

    assert took(5000) < 6 * took(50)


def test_occurs_is_the_pattern(spark):
    from quarrylark.operators.catalogue import occurs

    texts = ["a|b", "!!", "! !", "$%#", "x", "A.B", "a.b", "axb", "", None, "[", "\\"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for pattern in ("[|]", "!!", "[$%#&*]{3}", r"\.", "[.]", "a[.]b", r"!!|\|", ".", "[[]", "^!!", r"\\", "()"):
        got = [r[0] for r in df.select(occurs(F.col("t"), pattern)).collect()]
        assert got == [None if t is None else re.search(pattern, t, re.I) is not None for t in texts], pattern


def test_counts_are_those_of_mentions(spark, monkeypatch):
    df = spark.createDataFrame(list(enumerate(TEXTS * 3)), "id int, text string").repartition(3)
    want = {}
    for t in TEXTS * 3:
        for name, _, n in plain(VOCABULARY, t):
            texts, all_ = want.get(name, (0, 0))
            want[name] = texts + 1, all_ + n
    for size in (M.SLICE, 3):
        monkeypatch.setattr(M, "SLICE", size)
        got = {r["name"]: (r.texts, r.n) for r in M.mention_counts(df, "id", "text", VOCABULARY).collect()}
        assert got == want
    assert M.mention_counts(df, "id", "text", {}).count() == 0


def test_words_beside_a_sigma():
    """Lower case of a sigma depends on what follows in the text; a name doesn't."""
    m = M.Matcher([("exact", "ΑΣ"), ("any", "(?i)ΑΣ")])
    assert m.find("ΑΣ.Β ΑΣ") == [("exact", 0, 2), ("any", 0, 2)]


def test_many_hits_cost_little():
    """Words of a text are cut and counted at once, not handled one hit after another."""
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(500)]
    text = " ".join(rnd.choice(words) for _ in range(200_000))
    m = M.Matcher([(w, ("(?i)" if i % 2 else "") + w) for i, w in enumerate(words)])

    def took(f):
        best = 9e9
        for _ in range(3):
            began = time.process_time()
            f(text)
            best = min(best, time.process_time() - began)
        return best

    assert took(m.find) < 6 * took(re.compile(r"[\w-]+").findall)
