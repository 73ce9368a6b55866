"""Citation styles, exchange formats and numbering."""

import json

import pytest
from pyspark.sql import functions as F

from quarrylark.operators import citations as R
from quarrylark.operators.ordering import running_number

ROW = {"uid": "doi:10.1/x", "resource_type": "article", "date": "2013-05-02", "year": "2013", "authors": "Horvath S, Mary Jane Smith, Ageing Study Group", "title": "A title.", "venue": "Nature", "volume": "14", "issue": "2", "pages": "3-9", "doi": "10.1/x", "pmid": "", "url": ""}
WANT = {
    "APA": "Horvath, S., Smith, M. J., & Ageing Study Group (2013). A title. Nature, 14(2), 3-9. https://doi.org/10.1/x",
    "AMA": "Horvath S, Smith MJ, Ageing Study Group. A title. Nature. 2013;14(2):3-9. doi:10.1/x",
    "MLA": 'Horvath, S., et al. "A title." Nature, vol. 14, no. 2, 2013, pp. 3-9. https://doi.org/10.1/x.',
    "HAR": "Horvath, S., Smith, M.J. and Ageing Study Group (2013) 'A title', Nature, 14(2), pp. 3-9. doi:10.1/x.",
    "CHI": 'Horvath, S., M. J. Smith, and Ageing Study Group. 2013. "A title." Nature 14 (2): 3-9. https://doi.org/10.1/x.',
    "IEE": 'S. Horvath, M. J. Smith, and Ageing Study Group, "A title," Nature, vol. 14, no. 2, pp. 3-9, 2013, doi: 10.1/x.',
    "NAT": "Horvath, S., Smith, M. J. & Ageing Study Group A title. Nature 14, 3-9 (2013). https://doi.org/10.1/x",
    "ENW": "%0 Journal Article\n%A Horvath, S.\n%A Smith, M. J.\n%A Ageing Study Group\n%T A title\n%J Nature\n%D 2013\n%V 14\n%N 2\n%P 3-9\n%R 10.1/x\n%U https://doi.org/10.1/x",
}


@pytest.mark.parametrize("code", sorted(WANT))
def test_style(spark, code):
    assert R.render(spark.createDataFrame([ROW]), code, ["uid"], numbered=False).first().text == WANT[code]


def test_extremes(spark):
    empty = spark.createDataFrame([("u", None, None)], "uid string, title string, authors string")
    for code in R.CODES:
        assert R.render(empty, code, ["uid"]).first().text
    many = spark.createDataFrame([dict(ROW, authors=", ".join(f"Name{chr(65 + i)} X" for i in range(25)))])
    assert ", . . . NameY, X. (2013)." in R.render(many, "APA", ["uid"]).first().text
    assert R.render(many, "VAN", ["uid"]).first().text.startswith("1. NameA X, NameB X, NameC X, NameD X, NameE X, NameF X, et al. A title.")
    assert R.codes("apa, ieee,APA") == ["APA", "IEE"]
    with pytest.raises(ValueError):
        R.codes("xyz")


def test_running_number(spark):
    df = spark.range(0, 5000, 1, 13).select(F.abs(F.hash("id")).alias("h"), "id")
    assert [r.n for r in running_number(df, ["h", "id"]).orderBy("h", "id").collect()] == list(range(1, 5001))
    assert running_number(df.filter("id < 0"), ["h"]).count() == 0


def test_bibtex_and_csl(spark):
    rows = spark.createDataFrame([dict(ROW, uid=f"u{i}") for i in range(3)])
    got = [r.text for r in R.render(rows, "BIB", ["uid"]).orderBy("n").collect()]
    assert [t.split(",")[0] for t in got] == ["@article{horvath2013a", "@article{horvath2013aa", "@article{horvath2013ab"]
    assert "  pages = {3--9}" in got[0] and "{Ageing Study Group}" in got[0]
    item = json.loads(R.render(rows, "CSL", ["uid"]).first().text)
    assert item["author"] == [{"family": "Horvath", "given": "S."}, {"family": "Smith", "given": "M. J."}, {"literal": "Ageing Study Group"}]
    assert item["issued"] == {"date-parts": [[2013, 5, 2]]} and list(item) == sorted(item)
