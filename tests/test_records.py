"""Answers of sources become records; windows split and waits double."""

import json

import pytest

from quarrylark.sources import records as R
from quarrylark.sources import search as Q


def df(spark, *rows):
    return spark.createDataFrame([(r if isinstance(r, str) else json.dumps(r),) for r in rows], "value string")


def test_europe_pmc(spark):
    row = {"id": "1", "source": "PPR", "doi": "10.1101/X.v2", "title": "A <i>b</i>", "authorString": "A B, C D.", "isOpenAccess": "Y", "pubTypeList": {"pubType": ["Preprint"]}, "grantsList": {"grant": [{"agency": "Z"}, {"agency": "A"}, {"agency": "Z"}]}, "fullTextUrlList": {"fullTextUrl": [{"url": "u"}, {}]}}
    got = R.europe_pmc(df(spark, row, {"id": "PPR9", "source": "MED"})).collect()
    assert (got[0].uid[:4], got[0].journal, got[0].funders, got[0].fulltext_urls, got[0].is_preprint) == ("doi:", "preprint", "A; Z", ["u"], True)
    assert got[1].uid == "epmc:PPR9" and got[1].fulltext_urls == [] and got[1].cited_by == 0


def test_open_works(spark):
    w = {"id": "https://o.org/W1", "type": "article", "title": "T", "publication_date": "2020-02-03", "biblio": {"first_page": "1", "last_page": "9"}, "abstract_inverted_index": {"b": [1], "a": [0, 2]}, "authorships": [{"author": {"display_name": "X Y"}}], "primary_location": {"source": {"type": "conference"}}}
    got = R.open_works(df(spark, w, dict(w, type="paratext"), dict(w, title="", display_name=""))).collect()
    assert len(got) == 1
    assert (got[0].uid, got[0].pages, got[0].abstract, got[0].pub_types, got[0].pub_year) == ("url:o.org/w1", "1-9", "a b a", "conference paper", "2020")


def test_registry(spark):
    m = {"message": {"DOI": "10.1000/A", "type": "posted-content", "title": ["T"], "author": [{"family": "Doe", "given": "Jo Ann-Lee"}, {"name": "WHO"}], "issued": {"date-parts": [[2021]]}, "posted": {"date-parts": [[2020, 5]]}, "publisher": "P", "link": [{"URL": "u", "content-type": "application/pdf"}, {"URL": "v", "content-type": "text/html"}]}}
    r = R.registry_works(df(spark, m), {"posted-content": "preprint"}).first()
    assert (r.uid, r.authors, r.pub_date, r.journal, r.pub_types, r.fulltext_urls) == ("doi:10.1000/a", "Doe JAL, WHO", "2020-05-01", "P", "preprint", ["u"])


def test_pubmed(spark):
    xml = """<S><PubmedArticle><MedlineCitation><PMID>7</PMID><Article><Journal><Title>J</Title><JournalIssue><Volume>3</Volume><PubDate><MedlineDate>2019 Mar-Apr</MedlineDate></PubDate></JournalIssue></Journal><ArticleTitle>A <i>b</i></ArticleTitle>
    <Abstract><AbstractText Label="AIM">x</AbstractText><AbstractText>y</AbstractText></Abstract><AuthorList><Author><LastName>Doe</LastName><Initials>J</Initials></Author><Author><CollectiveName>WHO</CollectiveName></Author></AuthorList>
    <ArticleDate><Year>2019</Year><Month>02</Month><Day>5</Day></ArticleDate><PublicationTypeList><PublicationType>Retracted Publication</PublicationType></PublicationTypeList></Article></MedlineCitation>
    <PubmedData><ArticleIdList><ArticleId IdType="doi">10.1000/Z</ArticleId><ArticleId IdType="pmc">PMC5</ArticleId></ArticleIdList></PubmedData></PubmedArticle></S>"""
    got = R.pubmed(df(spark, xml, "<broken", "")).collect()
    assert len(got) == 1
    r = got[0]
    assert (r.uid, r.title, r.authors, r.abstract, r.pub_date, r.pmcid, r.retracted, r.in_pmc) == ("doi:10.1000/z", "A b", "Doe J, WHO", "AIM: x y", "2019-02-05", "PMC5", True, True)


def test_feed(spark):
    e = '<entry><id>http://arxiv.org/abs/{0}v2</id><published>{1}T00:00:00Z</published><title> A  b </title><author><name>X Y</name></author><category term="cs"/></entry>'
    xml = '<feed xmlns="http://www.w3.org/2005/Atom">' + e.format("2001.1", "2020-01-05") + e.format("1901.1", "2019-01-05") + "</feed>"
    got = R.preprint_feed(df(spark, xml), "2020-01-01", "2020-12-31").collect()
    assert [(r.uid, r.title, r.journal, r.fulltext_urls) for r in got] == [("doi:10.48550/arxiv.2001.1", "A b", "arXiv (cs)", ["https://arxiv.org/pdf/2001.1"])]


def test_first_copy(spark):
    t = spark.createDataFrame([("", "b", "p"), ("a", "b", "")], "pmc_xml string, epmc_xml string, oa_pdf string")
    assert [(r.xml, r.xml_source, r.pdf, r.pdf_source) for r in R.first_copy(t, ["pmc", "epmc", "oa"]).collect()] == [("b", "epmc", "p", "oa"), ("a", "pmc", "", "")]


class Days:
    """A service with one answer a day."""

    def count(self, query, lo, hi):
        from datetime import date

        return (date.fromisoformat(hi) - date.fromisoformat(lo)).days + 1

    def page(self, query, lo, hi, cursor):
        from datetime import date, timedelta

        day = cursor or lo
        after = (date.fromisoformat(day) + timedelta(days=1)).isoformat()
        return [f"{query} {day}"], after if after <= hi else ""


def test_search_source(spark):
    spark.dataSource.register(Q.Search)
    read = spark.read.format("search").options(**{"transport": "tests.test_records.Days", "query": "q", "from": "2020-01-01", "to": "2020-03-31", "cap": "10"}).load()
    rows = sorted(r.value for r in read.collect())
    assert len(rows) == 91 == len(set(rows)) and rows[0] == "q 2020-01-01" and rows[-1] == "q 2020-03-31"
    pieces = Q.split_window(lambda a, b: Days().count("", a, b), "2020-01-01", "2020-03-31", 10)
    assert all(Days().count("", *p) <= 10 for p in pieces) and len(pieces) > 8
    assert Q.split_window(lambda a, b: 99, "2020-01-01", "2020-01-02", 10) == [("2020-01-01", "2020-01-01"), ("2020-01-02", "2020-01-02")]
    assert Q.resume_from("2020-05-20", "2020-05-10") == "2020-05-10" and Q.resume_from("", "2020") == "2020"


def test_patience():
    waits: list[float] = []
    calls = iter([Q.Busy(), Q.Busy(5), Q.Busy(), None])

    def call():
        if (e := next(calls)) is not None:
            raise e
        return 1

    assert Q.patient(call, sleep=waits.append) == 1 and waits == [2.0, 5, 8.0]

    def busy():
        raise Q.Busy(601)

    with pytest.raises(Q.GivenUp):
        Q.patient(busy, sleep=waits.append)
