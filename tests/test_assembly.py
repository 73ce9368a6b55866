"""Catalogue assembly, inclusion, file actions and the report page on small rows."""

import pytest
from pyspark.sql import functions as F

from quarrylark.functions import scalars as S
from quarrylark.operators import files as L
from quarrylark.operators import inclusion as I
from quarrylark.operators import overview as O


def test_scalars(spark):
    import datetime as dt

    one = lambda e: spark.range(1).select(e.alias("x")).first().x
    assert one(S.keyword_union(F.lit("a; b"), F.lit("b; c"))) == "a; b; c"
    assert one(S.fulltext_sources(F.lit("10.1101/x"), F.lit("PMC1"), F.array(F.lit("PPR/1")), F.lit("u"))) == "pmc,biorxiv,europepmc,unpaywall,openalex"
    assert one(S.first_authors(F.lit("A B, C D, E F, G H."))) == "A B, C D, E F et al."
    assert one(S.resource_type(F.lit(False), F.lit("x"), F.lit("Technical Report; Thesis"))) == "thesis"
    today = dt.date(2024, 6, 1)
    assert S.window(span="7d", today=today) == ("2024-05-25", "")
    assert S.window(hi="2020", span="1y", today=today) == ("2019-12-31", "2020-12-31")  # 366 days back, as from today
    assert S.window(lo="2019", span="1y", today=today)[0] == "2019-01-01"


def test_files(spark):
    rows = spark.createDataFrame([("doi:10.1/a", "A")], "uid string, title string")
    papers = spark.createDataFrame([("doi:10.1/a", "paper.pdf", "pdf", "5", "p/paper.pdf")], "uid string, file string, ext string, bytes string, path string")
    cols = "uid string, file string, ext string, kind string, label string, caption string, bytes string, status string, path string, url string, reason string"
    atts = spark.createDataFrame([("doi:10.1/a", "f1.jpg", "jpg", "figure", "Fig 1", "clock", "9", "ok", "p/f1.jpg", "", ""), ("doi:10.1/a", "s.xlsx", "xlsx", "supplementary", "", "", "", "listed", "", "", "")], cols)
    files = L.listing(rows, papers, atts)
    names = lambda **k: sorted(r.file for r in L.pick(files, **k).collect())
    assert names() == ["f1.jpg", "paper.pdf"] and names(status="all", kind="attachment") == ["f1.jpg", "s.xlsx"]
    assert names(name="CLOCK") == ["f1.jpg"] and names(ext=".PDF") == ["paper.pdf"]
    with pytest.raises(ValueError):
        L.pick(files, kind="movie")
    with pytest.raises(ValueError):
        L.plan(files, "delete")
    moved = L.plan(L.pick(files), "move", "/d", flat=True)
    assert sorted(r.target for r in moved.collect()) == ["/d/10.1_a__f1.jpg", "/d/10.1_a__paper.pdf"]
    after = {r.file: (r.status, r.path) for r in L.settled(atts, moved, "move", "/d").collect()}
    assert after == {"f1.jpg": ("moved", "/d/10.1_a__f1.jpg"), "s.xlsx": ("listed", "")}


def test_files_settle_all_tables(spark):
    """One paper with a PDF, Markdown and two attachments: one moved, then the papers deleted."""
    from quarrylark.operators import assembly as A

    uid = "doi:10.1/a"
    cat = spark.createDataFrame([(uid, "Clock one", "ok", "p/paper.pdf", "p/paper.md", "2/2: jpg 1, xlsx 1")], "uid string, title string, fulltext_status string, fulltext_pdf string, fulltext_md string, attachments string")
    index = spark.createDataFrame([(uid, "ok", "", "True", "True", "2/2")], "uid string, status string, reason string, has_pdf string, has_md string, attachments string")
    papers = spark.createDataFrame([(uid, "paper.pdf", "pdf", "6", "p/paper.pdf"), (uid, "paper.md", "md", "3", "p/paper.md")], "uid string, file string, ext string, bytes string, path string")
    cols = "uid string, file string, ext string, kind string, label string, caption string, bytes string, status string, path string, url string, reason string"
    atts = spark.createDataFrame([(uid, "f1.jpg", "jpg", "figure", "Figure 1", "", "3", "ok", "p/attachments/f1.jpg", "", ""), (uid, "s1.xlsx", "xlsx", "supplementary", "", "eTable 1", "4", "ok", "p/attachments/s1.xlsx", "", "")], cols)
    moved = L.plan(L.pick(L.listing(cat, papers, atts), name="etable"), "move", "/out")
    atts = L.settled(atts, moved, "move", "/out")
    assert {r.file: (r.status, r.path) for r in atts.collect()} == {"f1.jpg": ("ok", "p/attachments/f1.jpg"), "s1.xlsx": ("moved", "/out/10.1_a/attachments/s1.xlsx")}
    gone = L.plan(L.pick(L.listing(cat, papers, atts), kind="paper"), "delete", confirmed=True)
    index = L.settled_index(index, L.settled(atts, gone, "delete"), gone, "delete")
    row = index.first()
    assert (row.status, row.has_pdf, row.has_md, row.attachments) == ("removed", "False", "False", "1/2")
    row = L.settled_catalogue(cat, index, A.attachment_summaries(atts), gone, "delete").first()
    assert (row.fulltext_status, row.fulltext_pdf, row.fulltext_md, row.attachments) == ("removed", "", "", "1/2: jpg 1, xlsx 1")


def test_linked_papers(spark):
    links = spark.createDataFrame([("r", "b", False), ("r", "a", True), ("r", "a", False), ("q", "z", True)], "repo string, uid string, own boolean")
    cat = spark.createDataFrame([("a", "core", "10.1/a"), ("b", "related", "")], "uid string, tier string, doi string")
    assert [tuple(r) for r in I.linked_papers(links, cat).collect()] == [("r", "a; b", "10.1/a", True, True)]


def test_report_and_findings(spark):
    df = spark.createDataFrame([("2020", "2020-01-01", "a|b", "article", "core", "3", "m; n", "ok", "u")], "year string, date string, title string, resource_type string, tier string, cited_by string, modality string, fulltext_status string, uid string")
    assert O.report_rows(O.report_page(df, "T <x>", ["title", "tier"], {"title": 2})) == {"columns": ["title", "tier"], "rows": [["a|", "core"]]}
    assert "a\\|b" in O.findings(df)
    assert O.search(df, "a CORE", ["title", "tier"], tier="core").count() == 1
