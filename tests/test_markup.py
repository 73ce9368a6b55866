"""Markup that is broken, page heads, article text, file names: typed expectations."""

import json

import pytest
from pyspark.sql import functions as F

from quarrylark.functions import scalars as S
from quarrylark.functions import terms as T
from quarrylark.functions.markup import events
from quarrylark.operators import articles as X
from quarrylark.operators import links as K
from quarrylark.operators import mining as M


def kinds(source):
    return [(k, v) for k, v, _ in events(source)]


def test_events_of_broken_markup():
    assert kinds("<a>x<b>y</a>z</b>") == [("open", "a"), ("text", "x"), ("open", "b"), ("text", "y"), ("close", "b"), ("close", "a"), ("text", "z")]
    assert kinds("<a><b/>t") == [("open", "a"), ("open", "b"), ("close", "b"), ("text", "t"), ("close", "a")]
    assert "".join(v for k, v, _ in events("1 < 2 <!-- no --> & &amp; &#233;&nothing; <![CDATA[<x>&amp;]]><?p?><!DOCTYPE a [<!ELEMENT b>]>") if k == "text") == "1 < 2  & & é&nothing; <x>&amp;"
    assert [a for _, _, a in events("<m:a xlink:href='x &gt; y' n=\"q'q\" bare=1>")][0] == {"href": "x > y", "n": "q'q", "bare": "1"}
    assert kinds("") == [] and kinds("<") == [("text", "<")]


ARTICLE = """<article xmlns:xlink="http://www.w3.org/1999/xlink"><front><journal-meta><journal-title>J of X</journal-title></journal-meta><article-meta>
<article-id pub-id-type="pmc">PMC77</article-id><title-group><article-title>On  <italic>it</italic></article-title></title-group>
<contrib-group><contrib contrib-type="author"><name><surname>Doe</surname><given-names>A B</given-names></name></contrib><contrib contrib-type="author"><collab>The Group</collab></contrib>
<contrib contrib-type="editor"><name><surname>No</surname></name></contrib></contrib-group><permissions><license><license-p>Open to all.</license-p></license></permissions>
<abstract abstract-type="toc"><p>not shown</p></abstract><abstract abstract-type="plain"><sec><title>Aim</title><p>To see.</p></sec></abstract></article-meta></front>
<body><sec><label>1</label><title>First</title><p>Text<sup>2</sup> <bold> b </bold><break/>end.</p><sec><title>Inner</title><list><list-item><p>x</p></list-item><list-item/></list></sec></sec>
<table-wrap><caption><title>Cap.</title><p>More.</p></caption><table><tr><td>a</td><td>b|c</td></tr><tr/></table><table-wrap-foot><fn><p>note</p></fn></table-wrap-foot></table-wrap>
<disp-quote><p>said</p></disp-quote><boxed-text><p>boxed</p></boxed-text><supplementary-material><caption><p>S cap</p></caption></supplementary-material></body>
<back><fn-group><fn><p>f1</p></fn></fn-group><ref-list><ref><element-citation><person-group>%s</person-group><article-title>Big</article-title><source>Src</source><fpage>3</fpage><pub-id pub-id-type="pmid">9</pub-id><pub-id pub-id-type="doi">10.1/q</pub-id></element-citation></ref><ref><note><p>none</p></note></ref>
<ref><label>3.</label><mixed-citation>Written, 2000.</mixed-citation></ref></ref-list></back></article>""" % "".join(f"<name><surname>N{i}</surname><given-names>G</given-names></name>" for i in range(7))


def test_article():
    md, front = X.article(ARTICLE)
    assert md == "\n\n".join([
        "# On *it*", "A B Doe, The Group", "J of X | PMC77 | license: Open to all.", "## Abstract (plain)", "### Aim", "To see.", "## 1 First", "Text^2^ **b** end.", "### Inner", "- x",
        "Cap. More.", "| a | b\\|c |\n|---|---|", "_note_", "said", "boxed", "*Supplementary material* S cap", "f1", "## References",
        "1. N0 G, N1 G, N2 G, N3 G, N4 G, N5 G et al.. Big. Src. 3 PMID:9 doi:10.1/q\n3.. Written, 2000.",
    ]) + "\n"
    assert json.loads(front) == {"title": "On *it*", "authors": ["A B Doe", "The Group"], "journal": "J of X", "keywords": [], "pmc": "PMC77", "license": "Open to all."}


def test_article_cut_anywhere_keeps_its_words():
    words = lambda s: set(s.split())
    body = "<article><body><sec><title>Head</title><p>one two <bold>three</bold> four</p><list><list-item><p>five</p></list-item></list></sec></body></article>"
    for at in range(len(body)):
        md, _ = X.article(body[:at])
        whole = {w for w in ("Head", "one", "two", "four", "five") if body[:at].find(w + "<") >= 0 or body[:at].find(w + " ") >= 0}
        assert whole <= words(md.replace("**", "").replace("<", "")), body[:at]


def test_captions_of_nested_and_cut_targets():
    xml = '<body><supplementary-material><label>S1</label><fig><label>in</label><graphic href="p/A.b.TIF"/></fig><caption><p>out</p></caption></supplementary-material><fig><graphic href="a.b.tif"/><label>late</label>'
    got = X.captions(xml)
    assert got == {"a.b.tif": ("supplementary", "S1", "out"), "a.b": ("supplementary", "S1", "out")}
    assert X.captions('<fig><graphic href="x.png"/><label>L</label><caption>c <b>d</b>') == {"x.png": ("figure", "L", "c d"), "x": ("figure", "L", "c d")}


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


@pytest.mark.parametrize(("md", "text"), [
    ("# H\n\n**a** *b* __c__ x*y 2 * 3", "H\n\na b c x*y 2 * 3\n"), ("| a | b |\n|---|---|\n| 1 | 2 |", "a\tb\n\n1\t2\n"), ("[t](http://u) H~2~O^+^", "t (http://u) H2O+\n"), ("----\n\n\n\n*x", "x\n"), ("", "\n"),
])
def test_markdown_text(spark, md, text):
    assert one(spark, X.markdown_text(F.lit(md))) == (text,)


@pytest.mark.parametrize(("head", "title", "description"), [
    ("<TITLE lang=x>A &ndash; B\n &eacute;&amp;lt;</TITLE><title>no</title>", "A – B é&lt;", ""),
    ('<meta name="description" content="A &amp; B">', "", "A & B"),
    ("<meta name='description' content='it \"is\"'>", "", 'it "is"'),
    ('<meta id="d" name="description" lang=en content="x > y">', "", "x > y"),
    ('<meta content="first" name="description"><meta name="description" content="second">', "", "first"),
    ('<meta property="og:description" content="og"><meta name="description" content="">', "", ""),
    ('<meta property="og:description" content="og"><meta name="keywords" content="k">', "", "og"),
    ("<title>" + "w " * 400 + "</title>", ("w " * 150).rstrip() + " ", ""),
    (None, "", ""),
])
def test_page_heads(spark, head, title, description):
    assert one(spark, M.page_title(F.lit(head).cast("string")), M.page_description(F.lit(head).cast("string"))) == (title, description)


def test_file_names_and_sizes(spark):
    for raw, want in (("_a_.", "a"), ("._x", "x"), ("d/e f?.pdf", "e_f_.pdf"), ("...", "file"), (None, "file"), ("a/", "file")):
        assert one(spark, X.safe_name(F.lit(raw).cast("string"))) == (want,)
    for n, want in ((None, ""), (0, "0 B"), (1023, "1023 B"), (1024, "1.0 KB"), (5 << 40, "5120.0 GB")):
        assert one(spark, S.human_bytes(F.lit(n).cast("long"))) == (want,)


def test_one_regex_borders_and_plurals(spark):
    for terms, text, want in (
        ([("networks",)], "a network", True), ([("networks",)], "networkses x", False), ([("class",)], "classes", True), ([("gas",)], "ga", False), ([("c++",)], "use c++, now", True), ([("c++",)], "xc++", False),
        ([("deep learning",)], "Deep-Learnings", True), ([("2020",)], "2020s", False), ([("a", "b")], "b then a", True), ([("a", "b"), ("z",)], "b only", False), ([(), ("z",)], "Z", True),
    ):
        assert one(spark, F.lit(text).rlike(T.one_regex(terms))) == (want,), (terms, text)


def test_a_catalogues_own_list_of_domains(spark):
    links = K.extract(spark.createDataFrame([(1, "https://a.doi.org/xyz https://mysite.org/abc https://notdoi.org/abc")], "uid int, text string"), "uid", "text")
    assert {r.domain for r in K.classified(links).collect()} == {"mysite.org", "notdoi.org"}
    assert {r.domain for r in K.classified(links, ["mysite.org"]).collect()} == {"a.doi.org", "notdoi.org"}
    assert K.classified(links, []).count() == 3
