"""Unit vectors of scalars, terms, filters, merging and citations, and the SQL twins on the smallest tables."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from quarrylark.functions import scalars as S
from quarrylark.functions import terms as T
from quarrylark.operators import catalogue as C
from quarrylark.operators import articles as X
from quarrylark.plans import registry
from quarrylark.sources import io

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


@pytest.mark.parametrize("raw, want", [("HTTPS://doi.org/10.1000/ABC.1", "10.1000/abc.1"), ("doi:10.1101/2020.01.01.123v2", "10.1101/2020.01.01.123"), ("junk", ""), (None, ""), ("10.1000/x).", "10.1000/x"), ("10.1000/a(b)c", "10.1000/a(b)c"), ("10.1000/10.1000/x", "10.1000/x"), ("10.1000/x,doi,not", "10.1000/x"), ("10.1000/x/suppl_file/y.pdf", "10.1000/x"), ("10.1101/1.2v3.full.pdf", "10.1101/1.2")])
def test_doi(spark, raw, want):
    assert one(spark, S.normalise_doi(F.lit(raw))) == want


def test_dates():
    today = dt.date(2024, 3, 31)
    assert S.parse_date("2024-02", end=True) == "2024-02-29"
    assert S.parse_date("2023", end=True) == "2023-12-31"
    assert S.parse_date("1m", today=today) == "2024-02-29"
    assert S.parse_date("2w", today=today) == "2024-03-17"
    for bad in ("2024-13", "5x", "20240315", ""):
        with pytest.raises(ValueError):
            S.parse_date(bad)


def test_terms(spark):
    assert T.parse_topic('a b, "c d" & e; a b OR f') == [("a", "b"), ("c d", "e"), ("f",)]
    assert T.parse_topic("") == []
    assert T.compiled(("CRISPR", "base editing"), "pubmed") == '("CRISPR"[tiab] AND "base editing"[tiab])'
    assert T.compiled(("epigenetic clock",), "europepmc") == 'TITLE_ABS:"epigenetic clock"'
    assert T.compiled(("a", "b c"), "arxiv") == '((ti:"a" OR abs:"a") AND (ti:"b c" OR abs:"b c"))'
    assert T.compiled(("a",), "arxiv") == 'ti:"a" OR abs:"a"'
    assert T.compiled(("CRISPR", "base editing"), "openalex") == '(CRISPR AND "base editing")'
    assert T.compiled(("graph", "neural networks"), "github") == '"graph" "neural networks"'
    rx = T.one_regex([("graph", "neural", "networks"), ("GNN",)])
    for text, want in (("A graph neural network for X", True), ("Neural networks on a graph", True), ("GNNs explained", True), ("neural networks only", False), ("graphene", False)):
        assert one(spark, F.lit(text).rlike(rx)) is want
    assert T.one_regex([]) == "(?!)"
    loose = [("CRISPR", "base editing")]
    for text, want in (("CRISPR-Cas9 base-editing tools", True), ("crispr and base editors... base editing", True), ("CRISPR database editing", False)):
        assert one(spark, T.matches(F.lit(text), loose)) is want
    for text, want in (("Advances in base editing.", True), ("base-editing", False), ("database editing", False)):
        assert one(spark, T.matches(F.lit(text), [("base editing",)], loose=False)) is want
    assert one(spark, T.matches(F.lit("boxes"), [("box",)])) is True and one(spark, T.matches(F.lit("a_gene"), [("gene",)])) is False
    terms = T.parse_topic('GNN, "neural network"')
    for text, want in (("GNNs are", True), ("a neural-network", True), ("graphene", False)):
        assert one(spark, T.matches(F.lit(text), terms)) is want
    assert one(spark, T.matches(F.lit("x"), [])) is False


def test_filters(spark):
    rows = [("2020-01-01", "a", "core", "2/3: jpg 2, xlsx 1", "ok", "methylation clock", "", 0), ("", "b", "related", "0/0", "", "other", "methylation", 1), ("2021-05-05", "c", "core", "", "none", "DNA x", "", 2)]
    df = spark.createDataFrame(rows, "date string, uid string, tier string, attachments string, fulltext_status string, summary string, keywords string, ord int")
    ids = lambda **k: sorted(r.uid for r in C.select(df, **k).collect())
    assert ids(summary="methylation") == ["a", "b"]
    assert ids(ext="XLSX") == ["a"]
    assert ids(has_attachments=True) == ["a"]
    assert ids(fulltext_status="-,none") == ["b", "c"]
    assert ids(date_to="2020-12-31") == ["a", "b"]
    assert ids(date_from="2020-01-01") == ["a", "c"]
    assert [r.uid for r in C.select(df, sort="date").collect()] == ["b", "a", "c"]
    assert C.select(df, limit=-1).count() == 2
    with pytest.raises(ValueError):
        C.select(df, title="(")


def test_merge_keeps_hand_written_columns(spark):
    schema = "uid string, title string, added_on string, notes string, user_tags string, status string"
    old = spark.createDataFrame([("a", "A", "2020-01-01", "mine", "t", ""), ("c", "C", "2020-01-01", "", "", "")], schema)
    new = spark.createDataFrame([("a", "A2", "", "", "", ""), ("d", "D", "", "", "", "")], schema)
    got = {r.uid: r for r in C.merge_catalogue(old, new, "2024-01-01").collect()}
    assert (got["a"].title, got["a"].notes, got["a"].added_on) == ("A2", "mine", "2020-01-01")
    assert got["c"].status and got["d"].added_on == "2024-01-01" and len(got) == 3


def test_csv_bytes():
    rows = [{"a": "x,y", "b": 'q"q', "c": " lead", "d": "l1\nl2", "e": None, "z": 1}]
    assert io.csv_text(list("abcde"), rows) == 'a,b,c,d,e\r\n"x,y","q""q", lead,"l1\nl2",\r\n'


def test_article_xml():
    xml = '<article><front><article-title>T</article-title></front><body><sec><title>S</title><p>a <italic>b</italic></p><fig><label>Fig 1</label><caption><p>cap</p></caption><graphic href="f1.jpg"/></fig></sec></body></article>'
    assert X.article(xml.replace("<article-title>", "<article-meta><article-title>").replace("</article-title>", "</article-title></article-meta>"))[0].startswith("# T\n\n## S\n\na *b*")
    assert X.article("<x") == ("", "") and X.article(None) == ("", "")
    named = """<article xmlns:xlink="http://www.w3.org/1999/xlink"><body><fig id="f1"><label>Figure 1.</label><caption><title>Clock <italic>accuracy</italic></title>
<p>Error by age.</p></caption><graphic xlink:href="pone.0123456.g001"/></fig><table-wrap id="t1"><label>Table 2</label><caption><p>Cohorts</p></caption><graphic xlink:href="tab2.gif"/></table-wrap>
<supplementary-material id="s1"><label>Supplement 1.</label><caption><p>eTable 1. Results</p></caption><media xlink:href="jamanetwopen-s001.xlsx"/></supplementary-material></body></article>"""
    caps = X.captions(named)
    assert caps["pone.0123456.g001"] == ("figure", "Figure 1.", "Clock accuracy Error by age.") and caps["tab2"] == ("table", "Table 2", "Cohorts")
    assert caps["jamanetwopen-s001.xlsx"] == ("supplementary", "Supplement 1.", "eTable 1. Results")


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name not in registry.ORACLES:
        assert len(got)
        return
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    plain = lambda v: list(v) if getattr(v, "ndim", 0) else v
    rows = lambda df: sorted(str([plain(v) for v in r]) for r in df[sorted(df.columns)].itertuples(index=False))
    assert rows(got) == rows(want)


def test_stream(spark, tmp_path):
    from quarrylark.streaming.hits import windowed_counts

    src = spark.read.parquet(f"{SF}/events.parquet")
    src.write.parquet(str(tmp_path / "in"))
    q = windowed_counts(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("hits").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert spark.sql("SELECT sum(n) FROM hits").first()[0] == src.count()
