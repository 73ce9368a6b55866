"""Queries of answers that the given tables stage: data registry, package indexes, archives, downloads on disk; and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylark.operators import files as L
from quarrylark.operators import repositories as P
from quarrylark.plans.registry import TODAY, query, table
from quarrylark.sources import records


def fields(**given):
    return F.struct(*[(F.lit(v) if isinstance(v, str) else v).alias(n) for n, v in given.items()])


@query("records_data_registry", """SELECT 'doi:10.5072/d' || doc_id AS uid, 'T ' || doc_id || ' & more' AS title, 'Doe, A, Group ' || lang AS authors, CASE doc_id % 3 WHEN 0 THEN '2021-05-06' WHEN 1 THEN '2019-01-02' ELSE '2018-01-01' END AS pub_date,
    source AS journal, 'dataset' AS pub_types, CASE WHEN doc_id % 2 = 0 THEN 'One. Two.' ELSE '' END AS abstract, 'https://r.org/' || lang AS license FROM documents""")
def _(spark, sf):
    i, k = F.col("doc_id"), F.col("doc_id").cast("string")
    day = lambda d, kind: fields(date=d, dateType=kind)
    dates = F.when(i % 3 == 0, F.array(day("2020", "Issued"), day("2021-05-06T00:00", "Issued"), day("2019-01-02", "Created"))).when(i % 3 == 1, F.array(day("2019-01-02", "Created"), day("2017", "Updated"))).otherwise(F.array(day("2017", "Updated"), day("", "Issued")))
    told = lambda t, kind: fields(description=t, descriptionType=kind)
    a = fields(
        doi=F.concat(F.lit("10.5072/D"), k), titles=F.array(fields(title=F.concat(F.lit("T "), k, F.lit(" &  <i>more</i>"))), fields(title="other")), creators=F.array(fields(name="Doe, A"), fields(name=F.concat(F.lit("Group "), "lang"))),
        dates=dates, publicationYear=F.lit(2018), publisher=F.col("source"), url=F.concat(F.lit("https://x.org/"), k), types=fields(resourceTypeGeneral="Dataset"),
        descriptions=F.when(i % 2 == 0, F.array(told("One.", "Abstract"), told("no", "Methods"), told("Two.", "Abstract"))), rightsList=F.array(fields(rightsUri=F.concat(F.lit("https://r.org/"), "lang")), fields(rightsUri="z")),
    )
    got = records.data_works(table(spark, sf, "documents").select(F.to_json(fields(data=fields(attributes=a))).alias("value")))
    return got.select("uid", "title", "authors", "pub_date", "journal", "pub_types", "abstract", "license")


@query("packages_cran", "SELECT 'pkg' || p_partkey AS name, 'https://cran.r-project.org/package=pkg' || p_partkey AS url, p_brand || '. About ' || p_type AS description, 'GPL-3' AS license, '2014-05-01' AS created, '2020-02-0' || (p_partkey % 9 + 1) AS updated FROM part")
def _(spark, sf):
    k = F.col("p_partkey")
    old, new = fields(Title="old", Description="old", License="MIT"), fields(Title=F.col("p_brand"), Description=F.concat(F.lit("About "), "p_type"), License="GPL-3")
    last = F.concat(F.lit("2020-02-0"), (k % 9 + 1).cast("string"), F.lit("T10:00:00+00:00"))
    body = fields(name=F.concat(F.lit("pkg"), k.cast("string")), latest="1.1", timeline=F.create_map(F.lit("1.0"), F.lit("2014-05-01T08:00:00+00:00"), F.lit("1.1"), last), versions=F.create_map(F.lit("1.0"), old, F.lit("1.1"), new))
    return P.index_packages(table(spark, sf, "part").select(F.to_json(body).alias("value")), "cran").select("name", "url", "description", "license", "created", "updated")


@query("packages_bioconductor", """SELECT 'bioc' || p_partkey AS name, 'https://bioconductor.org/packages/bioc' || p_partkey AS url, p_brand || ' for ' || p_type AS description, CASE WHEN p_partkey % 2 = 0 THEN 'GPL' ELSE '' END AS license,
    CASE WHEN p_partkey % 3 = 0 THEN '2015-03-01' ELSE '' END AS created, '2024-03-0' || (p_partkey % 9 + 1) AS updated FROM part""")
def _(spark, sf):
    p, k = table(spark, sf, "part"), F.col("p_partkey")
    name = F.concat(F.lit("bioc"), k.cast("string"))
    d = fields(Title=F.concat("p_brand", F.lit(" for\n")), Description=F.concat(F.lit("  "), "p_type"), License=F.when(k % 2 == 0, "GPL"), git_last_commit_date=F.concat(F.lit("2024-03-0"), (k % 9 + 1).cast("string"), F.lit(" 10:00")))
    # one answer lists a release's packages; each is the list of one package here
    answers = p.select(F.to_json(F.create_map(name, d)).alias("value"))
    months = p.filter(k % 3 == 0).select(name.alias("name"), F.explode(F.array(*[fields(year=F.lit(y), month=m, n=F.lit(n)) for y, m, n in ((2015, "Feb", 0), (2015, "Mar", 3), (2016, "Jan", 9), (2015, "all", 3))])).alias("m")).select("name", "m.*")
    return P.bioconductor_packages(answers, P.first_month(months))


@query("archive_rows", """SELECT o_orderkey AS number, CASE WHEN o_orderkey % 4 = 0 THEN 'zenodo:' || o_orderkey ELSE 'Data ' || o_orderkey END AS name, CASE WHEN o_orderkey % 2 = 0 THEN 'https://zenodo.org/records/' || o_orderkey ELSE 'https://doi.org/l' || o_orderkey END AS url,
    substr(repeat(' b x  ' || o_orderkey, 60), 1, 600) AS description, CASE WHEN o_orderkey % 3 = 0 THEN '2020-01-02' ELSE '2019-12-31' END AS created, '2021-05-06' AS updated, '10.5281/zenodo.' || o_orderkey AS doi, 'cc-by-4.0' AS license, 'dataset' AS resource FROM orders""")
def _(spark, sf):
    k = F.col("o_orderkey")
    n = k.cast("string")
    m = fields(title=F.when(k % 4 != 0, F.concat(F.lit("Data "), n)), description=F.repeat(F.concat(F.lit("<p>b<br/>x</p> "), n), 60), publication_date="2019-12-31", license=fields(id="cc-by-4.0"), resource_type=fields(type="dataset"))
    body = fields(id=n, doi=F.concat(F.lit("10.5281/zenodo."), n), created=F.when(k % 3 == 0, "2020-01-02T00:00:00"), updated="2021-05-06T01:02:03", links=fields(html=F.when(k % 2 == 0, F.concat(F.lit("https://zenodo.org/records/"), n))), metadata=m)
    answers = table(spark, sf, "orders").select(k.alias("number"), F.concat(F.lit("https://doi.org/l"), n).alias("link"), F.to_json(body).alias("value"))
    return P.archive_records(answers, ["number", "link"]).drop("link")


@query("fulltext_on_disk", f"""SELECT 'doc:' || doc_id AS uid, 'pmc' AS source, doc_id % 5 <> 3 AS has_pdf, true AS has_md, CASE WHEN doc_id % 5 = 0 THEN 'https://p/' || doc_id ELSE '' END AS pdf_url,
    CASE WHEN doc_id % 2 = 0 THEN '2024-02-03' ELSE '{TODAY}' END AS checked_on FROM documents WHERE doc_id % 5 IN (0, 3)""")
def _(spark, sf):
    """Of five downloads two are whole: one with its PDF, one without; others lack a listed file, a plain format, or are no download."""
    i, k = F.col("doc_id"), F.col("doc_id").cast("string")
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("doc:"), k).alias("uid"), F.concat(F.lit("/fulltext/2020/d"), k).alias("folder"))
    listed = F.when(i % 5 == 0, F.create_map(F.lit("paper.pdf"), fields(url=F.concat(F.lit("https://p/"), k)))).when(i % 5 == 1, F.create_map(F.lit("lost.pdf"), fields(url="x")))
    note = fields(fulltext=fields(status=F.when(i % 5 == 4, "partial").otherwise("ok"), source="pmc", fetched_on=F.when(i % 2 == 0, "2024-02-03T04:05:06"), files=listed))
    notes = d.select("folder", F.to_json(note).alias("value"))
    names = F.when(i % 5 == 2, F.array(F.lit("paper.md"), F.lit("paper.pdf"))).when(i % 5 == 3, F.array(F.lit("paper.md"), F.lit("paper.txt"), F.lit("other"))).otherwise(F.array(F.lit("paper.md"), F.lit("paper.txt"), F.lit("paper.pdf"), F.lit("metadata.json")))
    found = d.select("folder", F.explode(names).alias("file"))
    return L.from_disk(d, notes, found, TODAY).select("uid", "source", "has_pdf", "has_md", "pdf_url", "checked_on")
