"""Queries of filters, scalars, joins, mining, look-ups and sinks over a catalogue made of documents, and their SQL twins.

The catalogue is stated once, in SQL that both engines read (`PAPERS`); what is tested is stated twice: the operator here,
and plain SQL or typed values beside it.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylark.functions import scalars as S
from quarrylark.functions import terms as T
from quarrylark.operators import articles as X
from quarrylark.operators import assembly as A
from quarrylark.operators import catalogue as C
from quarrylark.operators import citations as R
from quarrylark.operators import files as L
from quarrylark.operators import inclusion as I
from quarrylark.operators import links as K
from quarrylark.operators import mining as M
from quarrylark.operators import overview as O
from quarrylark.operators import repositories as P
from quarrylark.operators import scope as U
from quarrylark.operators import snapshots as Z
from quarrylark.plans.references import CITED, SQL, cited
from quarrylark.plans.registry import TODAY, query, table
from quarrylark.sources import config as Y
from quarrylark.sources import io, lookups, onefile, records
from quarrylark.storage import shared_folder as scratch

COLUMNS = {
    "k": "doc_id", "uid": "'doc:' || doc_id", "title": "split_part(coalesce(text, ''), chr(10), 1)", "abstract": "coalesce(text, '')",
    "date": "CASE WHEN doc_id % 13 = 0 THEN '' ELSE CAST(DATE '2010-01-01' + CAST(doc_id % 5000 AS INT) AS STRING) END",
    "doi": "CASE WHEN doc_id % 7 = 0 THEN '' ELSE '10.1000/' || doc_id END", "pmid": "CASE WHEN doc_id % 5 = 0 THEN '' ELSE CAST(doc_id + 100 AS STRING) END",
    "tier": "CASE doc_id % 3 WHEN 0 THEN 'landmark' WHEN 1 THEN 'core' ELSE 'related' END",
    "resource_type": "CASE doc_id % 5 WHEN 0 THEN 'article' WHEN 1 THEN 'review' WHEN 2 THEN 'preprint' WHEN 3 THEN 'dataset' ELSE 'website' END",
    "modality": "CASE doc_id % 5 WHEN 0 THEN 'DNA methylation; Transcriptome' WHEN 1 THEN 'Proteome' WHEN 2 THEN '' WHEN 3 THEN 'transcriptome' ELSE 'Microbiome; Proteome' END",
    "entities": "CASE doc_id % 6 WHEN 0 THEN 'Horvath; PhenoAge' WHEN 1 THEN 'list registry: c' || doc_id || ', d; GrimAge' WHEN 2 THEN 'GrimAge' ELSE '' END",
    "species": "CASE doc_id % 4 WHEN 0 THEN 'human; mouse' WHEN 1 THEN 'mouse' WHEN 2 THEN '' ELSE 'Rat' END",
    "added_on": "'2024-0' || (1 + doc_id % 9) || '-15'", "fulltext_md": "CASE WHEN doc_id % 2 = 0 THEN 'fulltext/' || doc_id || '/paper.md' ELSE '' END",
    "fulltext_status": "CASE doc_id % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'partial' WHEN 2 THEN 'deferred' WHEN 3 THEN 'none' ELSE '' END",
    "attachments": "CASE doc_id % 4 WHEN 0 THEN '2/3: jpg 2, xlsx 1' WHEN 1 THEN '0/0' WHEN 2 THEN '' ELSE '1/1: pdf 1' END",
    "summary": "substr(coalesce(text, ''), 1, 300)", "keywords": "lang", "venue": "source", "matched_groups": "lang", "details": "'stars=' || doc_id % 50",
    "authors": "CASE doc_id % 3 WHEN 0 THEN 'Smith J, Doe A' WHEN 1 THEN '' ELSE 'Zed, Adams B' END", "cited_by": "CAST(n_chars % 1000 AS STRING)", "year": "CAST(2010 + doc_id % 14 AS STRING)",
    "summary_from": "CASE WHEN doc_id % 2 = 0 THEN 'abstract' ELSE '' END", "pending": "CASE WHEN doc_id % 9 = 0 THEN 'full text' ELSE '' END", "code_links": "CASE doc_id % 8 WHEN 0 THEN 'https://a.b/c; https://d.e/f' WHEN 1 THEN 'https://g.h/i' ELSE '' END",
}
PAPERS = "papers AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in COLUMNS.items()) + " FROM documents)"


def papers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").selectExpr(*[f"{e} AS {n}" for n, e in COLUMNS.items()])


def kept(name: str, where: str, **conditions) -> None:
    """A query of one filter of the combined selection."""
    query(name, f"WITH {PAPERS} SELECT uid FROM papers WHERE {where}")(lambda spark, sf: C.select(papers(spark, sf), **conditions).select("uid"))


# ---------------------------------------------------------------- filters

kept("filter_doi", "doi IN ('10.1000/5', '10.1000/12', '10.1000/400')", dois=["10.1000/5", "https://doi.org/10.1000/12", "DOI:10.1000/400", "junk"])
kept("filter_uid", "uid IN ('doc:3', 'doc:77')", uids=["doc:3", "doc:77", "none"])
kept("filter_type", "resource_type IN ('review', 'preprint')", kind="Review,PREPRINT")
kept("filter_modality", "contains(lower(modality), 'transcript') OR contains(lower(modality), 'micro')", modality="TRANSCRIPT, micro")
kept("filter_entity", "contains(lower(entities), 'grimage')", entity="GrimAge")
kept("filter_species", "contains(lower(species), 'human') OR contains(lower(species), 'rat')", species="human,rat")
kept("filter_added_since", "added_on >= '2024-05'", added_since="2024-05")
kept("filter_has_fulltext", "fulltext_md <> ''", has_fulltext=True)
kept("filter_fulltext_status", "fulltext_status IN ('', 'none')", fulltext_status="-,NONE")
kept("filter_has_attachments", "attachments LIKE '2/3%' OR attachments LIKE '1/1%'", has_attachments=True)
kept("filter_ext", "attachments LIKE '%xlsx%' OR attachments LIKE '%pdf%'", ext=".XLSX,pdf")
kept("filter_summary", "regexp_matches(summary || ' ' || keywords, '^the|fr$', 'i')", summary="^the|fr$")
kept("filter_text", "regexp_matches(title || ' ' || entities || ' ' || venue || ' ' || matched_groups || ' ' || details, 'grimage.*src1.*stars=[0-4]$', 'i')", text="grimage.*src1.*stars=[0-4]$")


@query("filter_fulltext_context", f"""WITH {PAPERS}, m AS (SELECT uid, abstract, regexp_extract(abstract, '(?i)[a-z]+tion[.]') AS hit FROM papers WHERE regexp_matches(abstract, '[a-z]+tion[.]', 'i'))
    SELECT uid, trim(regexp_replace(substr(abstract, CAST(greatest(instr(abstract, hit) - 80, 1) AS BIGINT), CAST(instr(abstract, hit) + length(hit) + 80 - greatest(instr(abstract, hit) - 80, 1) AS BIGINT)), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS context FROM m""")
def _(spark, sf):
    return C.select(papers(spark, sf).withColumn("fulltext", F.col("abstract")), fulltext="[a-z]+tion[.]").select("uid", "context")


@query("filter_window_shifted", "SELECT o_orderkey FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') BETWEEN '1997-06-30' AND '1998-06-30'")
def _(spark, sf):
    lo, hi = S.window(hi="1998-06", span="1y", today=dt.date(1998, 1, 1))
    o = table(spark, sf, "orders")
    return o.filter(C.in_window(F.date_format("o_orderdate", "yyyy-MM-dd"), lo, hi)).select("o_orderkey")


@query("select_value_list", f"WITH {PAPERS} SELECT uid FROM papers WHERE uid IN ('doc:1', 'doc:10', 'doc:100')")
def _(spark, sf):
    return C.select(papers(spark, sf), uids=Y.values(spark, "doc:1, doc:10,, doc:100,zzz", "uid")).select("uid")


@query("select_doi_file", f"WITH {PAPERS} SELECT uid FROM papers WHERE doi <> '' AND k % 3 = 0")
def _(spark, sf):
    where = scratch(spark, "dois")
    raw = papers(spark, sf).filter("doi <> '' AND k % 3 = 0").select(F.concat(F.lit(" https://doi.org/"), F.upper("doi"), F.lit(" ")).alias("value"))
    raw.unionByName(spark.createDataFrame([("",), ("junk",)], "value string")).write.text(where)
    return C.select(papers(spark, sf), dois=Y.values(spark, "@" + where, "doi")).select("uid")


FILES = """f AS (SELECT 'ord:' || l_orderkey AS uid, 'f' || l_linenumber || '.' || lower(l_returnflag) AS file, lower(l_returnflag) AS ext, CASE WHEN l_linestatus = 'F' THEN 'figure' ELSE 'supplementary' END AS kind,
    CASE WHEN l_linenumber % 2 = 0 THEN 'Figure ' || l_linenumber ELSE '' END AS label FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""


def listed(spark, sf) -> DataFrame:
    uid = lambda c: F.concat(F.lit("ord:"), F.col(c).cast("string")).alias("uid")
    rows = table(spark, sf, "orders").select(uid("o_orderkey"), F.lit("").alias("title"))
    blank = lambda *names: [F.lit("").alias(n) for n in names]
    n = F.col("l_linenumber").cast("string")
    atts = table(spark, sf, "lineitem").select(uid("l_orderkey"), F.concat(F.lit("f"), n, F.lit("."), F.lower("l_returnflag")).alias("file"), F.lower("l_returnflag").alias("ext"), F.when(F.col("l_linestatus") == "F", "figure").otherwise("supplementary").alias("kind"), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("Figure "), n)).otherwise("").alias("label"), F.lit("ok").alias("status"), *blank("bytes", "path", "caption", "url"))
    return L.listing(rows, atts.limit(0).select("uid", "file", "ext", "bytes", "path"), atts)


@query("files_by_ext", f"WITH {FILES} SELECT uid, file FROM f WHERE ext IN ('a', 'r') AND kind = 'figure'")
def _(spark, sf):
    return L.pick(listed(spark, sf), ext=".A,r", kind="figure").select("uid", "file")


@query("files_by_name", f"WITH {FILES} SELECT uid, file FROM f WHERE regexp_matches(file || ' ' || label, 'figure 2|f1[.]n', 'i')")
def _(spark, sf):
    return L.pick(listed(spark, sf), name="figure 2|f1[.]n", status="all").select("uid", "file")


# ---------------------------------------------------------------- terms


@query("term_match_strict", r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(^|[^\p{L}\p{M}\p{Nd}\p{Pc}-])the and([^\p{L}\p{M}\p{Nd}\p{Pc}-]|$)', 'i')")
def _(spark, sf):
    return table(spark, sf, "documents").filter(T.matches(F.col("text"), [("the and",)], loose=False)).select("doc_id")


@query("term_one_regex", r"SELECT doc_id FROM documents WHERE (regexp_matches(text, '\b(und)(e?s)?\b', 'i') AND regexp_matches(text, '\b(der)(e?s)?\b', 'i')) OR regexp_matches(text, '\b(the)[\s-]+(thi)(e?s)?\b', 'i')".replace(r"\s", r"[:space:]").replace("[[:space:]-]", "[[:space:]-]"))
def _(spark, sf):
    return table(spark, sf, "documents").filter(F.col("text").rlike(T.one_regex(T.parse_topic('und & der, "the this"')))).select("doc_id")


@query("residual_recheck", r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(^|[^\p{L}\p{M}\p{Nd}\p{Pc}])the(e?s)?([^\p{L}\p{M}\p{Nd}\p{Pc}]|$)', 'i') AND regexp_matches(text, '(^|[^\p{L}\p{M}\p{Nd}\p{Pc}])and(e?s)?([^\p{L}\p{M}\p{Nd}\p{Pc}]|$)', 'i') AND n_chars >= 500 AND n_chars <= 3000")
def _(spark, sf):
    hits = table(spark, sf, "documents").withColumn("size", F.lpad(F.col("n_chars").cast("string"), 9, "0"))
    return hits.filter(T.group_filter(F.col("text"), T.parse_topic("the"), T.parse_topic("and"), F.col("size"), "000000500", "000003000")).select("doc_id")


# ---------------------------------------------------------------- scalars


@query("identifier_chain", """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'doi:10.1234/a' || doc_id WHEN 1 THEN 'pmid:' || doc_id WHEN 2 THEN 'pmcid:PMC' || doc_id WHEN 3 THEN 'epmc:PPR' || doc_id ELSE 'url:site.org/p' || doc_id END AS uid FROM documents""")
def _(spark, sf):
    k = F.col("doc_id").cast("string")
    only = lambda i, *parts: F.when(F.col("doc_id") % 5 == i, F.concat(*parts)).otherwise("")
    uid = S.make_uid(only(0, F.lit("doi:10.1234/A"), k, F.lit(".")), F.when(F.col("doc_id") % 5 == 1, F.concat(F.lit("PMID "), k)).otherwise(F.when(F.col("doc_id") % 5 == 2, "0").otherwise("")), F.when(F.col("doc_id") % 5 == 2, k).otherwise("PMC1x"), only(3, F.lit("ppr"), k), only(4, F.lit(" https://www.Site.org/p"), k, F.lit("/")))
    return table(spark, sf, "documents").select("doc_id", uid.alias("uid"))


@query("identifier_numbers", """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '0' || doc_id WHEN 1 THEN '' WHEN 2 THEN CAST(doc_id AS VARCHAR) ELSE '' END AS pmid,
    CASE doc_id % 4 WHEN 0 THEN 'PMC' || doc_id WHEN 1 THEN 'PMC' || doc_id WHEN 2 THEN '' ELSE '' END AS pmcid FROM documents""")
def _(spark, sf):
    k, n = F.col("doc_id").cast("string"), F.col("doc_id") % 4
    pmid = F.when(n == 0, F.concat(F.lit("0"), k)).when(n == 1, "0").when(n == 2, F.concat(F.lit("pmid: "), k)).otherwise("none")
    pmcid = F.when(n == 0, F.concat(F.lit(" pmc"), k)).when(n == 1, F.concat(F.lit("id "), k)).when(n == 2, F.concat(F.lit("PMC"), k, F.lit("x"))).otherwise("")
    return table(spark, sf, "documents").select("doc_id", S.normalise_pmid(pmid).alias("pmid"), S.normalise_pmcid(pmcid).alias("pmcid"))


@query("file_slug", """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '10.1_a-' || doc_id || '.x' ELSE repeat('ab_', 37) || '_' || substr(sha1('u:' || repeat('ab ', 50) || doc_id), 1, 8) END AS slug FROM documents""")
def _(spark, sf):
    k = F.col("doc_id").cast("string")
    uid = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("doi:10.1/a-"), k, F.lit(".x/"))).otherwise(F.concat(F.lit("u:"), F.repeat(F.lit("ab "), 50), k))
    return table(spark, sf, "documents").select("doc_id", S.slug(uid).alias("slug"))


@query("date_sharpen", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 3 = 0 THEN '1990-01-01' ELSE '1990-06-05' END AS day FROM orders")
def _(spark, sf):
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    own = F.when(k % 2 == 0, F.concat(F.substring(day, 1, 4), F.lit("-01-01"))).when(k % 3 == 0, "1990-01-01").otherwise("1990-06-05")
    return table(spark, sf, "orders").select("o_orderkey", S.sharpen(own, F.when((k % 2 == 0) | (k % 3 > 0), day).otherwise("")).alias("day"))


@query("venue_spelling", "SELECT doc_id, CASE WHEN source LIKE 'src1%' THEN 'Source One' WHEN source = 'src2' THEN 'Two' ELSE source END AS venue FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.venue(F.col("source"), {"SRC1": "Source One", "src2": "Two"}).alias("venue"))


@query("paper_scalars", f"""WITH {PAPERS} SELECT uid, CASE WHEN doi <> '' THEN 'https://doi.org/' || doi WHEN pmid <> '' THEN 'https://pubmed.ncbi.nlm.nih.gov/' || pmid || '/' ELSE 'https://x.y/' || k END AS url,
    CASE WHEN k % 10 = 0 OR fulltext_status IN ('ok', 'partial') THEN 'yes' WHEN fulltext_status = '' THEN 'unknown' ELSE 'no' END AS open_access,
    CASE k % 3 WHEN 0 THEN 'smith' WHEN 1 THEN lower(title) ELSE 'zed' END AS author_key, CASE WHEN attachments = '' THEN 0 ELSE CAST(substr(attachments, 3, 1) AS INTEGER) END AS total,
    CASE k % 3 WHEN 0 THEN 'a; ' || keywords || '; b' ELSE 'a; ' || keywords END AS words FROM papers""")
def _(spark, sf):
    c = F.col
    k = c("k").cast("string")
    return papers(spark, sf).select(
        "uid", S.landing_url(c("doi"), c("pmid"), F.concat(F.lit("https://x.y/"), k)).alias("url"), S.open_access(c("k") % 10 == 0, c("fulltext_status")).alias("open_access"), S.author_key(c("authors"), c("title")).alias("author_key"),
        S.attachment_total(c("attachments")).alias("total"), S.keyword_union(F.concat(F.lit("a;"), c("keywords"), F.lit("; a")), F.when(c("k") % 3 == 0, F.concat(F.lit("b; "), c("keywords"))).otherwise("")).alias("words"),
    )


@query("file_names", """SELECT l_orderkey, l_linenumber, lower(l_returnflag) || 'x' AS ext, 'A.' || l_linenumber AS stem, CASE l_linenumber % 5 WHEN 0 THEN '512 B' WHEN 1 THEN '2.0 KB' WHEN 2 THEN '1.5 MB' WHEN 3 THEN '3.0 GB' ELSE '' END AS size,
    CASE l_linenumber % 4 WHEN 0 THEN 'c_.' || lower(l_returnflag) WHEN 1 THEN 'file' WHEN 2 THEN 'a' ELSE 'x_y' END AS safe FROM lineitem""")
def _(spark, sf):
    n = F.col("l_linenumber")
    name = F.concat(F.lit("A."), n.cast("string"), F.lit("."), F.col("l_returnflag"), F.lit("X"))
    size = F.when(n % 5 == 0, 512).when(n % 5 == 1, 2048).when(n % 5 == 2, 3 << 19).when(n % 5 == 3, F.lit(3 << 30))
    raw = F.when(n % 4 == 0, F.concat(F.lit("a b/../c?."), F.lower("l_returnflag"))).when(n % 4 == 1, "..._").when(n % 4 == 2, "_a_.").otherwise("._x (y)")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.extension(name).alias("ext"), S.stem(name).alias("stem"), S.human_bytes(size).alias("size"), X.safe_name(raw).alias("safe"))


@query("fulltext_sources", f"""WITH {PAPERS} SELECT uid, array_to_string(list_filter([CASE WHEN k % 2 = 0 THEN 'pmc' END, CASE WHEN k % 3 = 0 THEN 'biorxiv' END, CASE WHEN k % 4 = 0 THEN 'europepmc' END, CASE WHEN k % 3 = 1 THEN 'arxiv' END,
    CASE WHEN k % 3 < 2 OR doi <> '' THEN 'unpaywall' END, CASE WHEN k % 5 = 0 THEN 'openalex' END], lambda x: x IS NOT NULL), ',') AS sources FROM papers""")
def _(spark, sf):
    k = F.col("k")
    doi = F.when(k % 3 == 0, F.concat(F.lit("10.1101/"), k.cast("string"))).when(k % 3 == 1, "10.48550/ARXIV.1").otherwise(F.col("doi"))
    return papers(spark, sf).select("uid", S.fulltext_sources(doi, F.when(k % 2 == 0, "PMC1").otherwise(""), F.when(k % 4 == 0, F.array(F.lit("MED/1"), F.lit("PPR/2"))), F.when(k % 5 == 0, "u").otherwise("")).alias("sources"))


@query("abstract_from_index", "SELECT doc_id, 'one ' || lang || ' two ' || lang AS abstract FROM documents")
def _(spark, sf):
    index = F.create_map(F.lit("two"), F.array(F.lit(2)), F.lit("one"), F.array(F.lit(0)), F.col("lang"), F.array(F.lit(3), F.lit(1)))
    return table(spark, sf, "documents").select("doc_id", S.abstract_from_index(index).alias("abstract"))


@query("citation_kit", "SELECT doc_id, 'n.d.' AS no_year, 'A title' AS bare, 'A title.' AS sentence, 'A title?' AS asked, 'a \\& b\\_1 50\\%' AS latex FROM documents")
def _(spark, sf):
    t = F.lit("A  title.")
    return table(spark, sf, "documents").select("doc_id", R.year_of(F.lit("")).alias("no_year"), R.bare(t).alias("bare"), R.sentence(F.lit("A title")).alias("sentence"), R.sentence(F.lit("A title?")).alias("asked"), R.latex(F.lit("a & b_1 50%")).alias("latex"))


# ---------------------------------------------------------------- links and texts

SAID = "'Code at https://github.com/o' || doc_id || '/R' || doc_id || '.git, and (http://www.site' || doc_id % 50 || '.org/p). See gitlab.com/a/b' || doc_id || '; refs https://doi.org/10.1000/X' || doc_id || ').'"


def said(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").selectExpr("doc_id AS uid", f"{SAID} AS text")


FOUND = f"""t AS (SELECT doc_id AS uid, {SAID} AS text FROM documents), l AS (
    SELECT uid, text, 0 AS pos, 'https://github.com/o' || uid || '/R' || uid || '.git' AS raw, 1 AS a, 999 AS z FROM t UNION ALL
    SELECT uid, text, 1, 'https://www.site' || uid % 50 || '.org/p', 1, 999 FROM t UNION ALL
    SELECT uid, text, 2, 'https://doi.org/10.1000/X' || uid, 1, 999 FROM t UNION ALL
    SELECT uid, text, 3, 'gitlab.com/a/b' || uid, 1, 999 FROM t)"""


@query("link_find", f"WITH {FOUND} SELECT uid, pos, raw FROM l")
def _(spark, sf):
    return K.extract(said(spark, sf), "uid", "text").select("uid", "pos", "raw")


@query("link_context", """SELECT doc_id AS uid, repeat('x', 119 - 1) || 'y https://github.com/a/b' || doc_id || ' ' || repeat('z', 79) AS context FROM documents""")
def _(spark, sf):
    text = F.concat(F.repeat(F.lit("x"), 400), F.lit("y https://github.com/a/b"), F.col("doc_id").cast("string"), F.lit(" "), F.repeat(F.lit("z"), 300))
    return K.extract(table(spark, sf, "documents").select(F.col("doc_id").alias("uid"), text.alias("text")), "uid", "text").select("uid", "context")


@query("link_classify", f"""WITH {FOUND} SELECT uid, 'https://github.com/o' || uid || '/R' || uid AS url, 'github' AS kind, 'github.com' AS domain FROM t UNION ALL
    SELECT uid, 'https://site' || uid % 50 || '.org/p', 'website', 'site' || uid % 50 || '.org' FROM t UNION ALL SELECT uid, 'https://gitlab.com/a/b' || uid, 'gitlab', 'gitlab.com' FROM t""")
def _(spark, sf):
    return K.classified(K.extract(said(spark, sf), "uid", "text")).select("uid", "url", "kind", "domain")


@query("paper_links", f"""WITH {FOUND} SELECT uid, 'https://github.com/o' || uid || '/R' || uid AS url, 'github' AS kind, CASE WHEN uid % 2 = 0 THEN 'abstract' ELSE 'fulltext' END AS "where" FROM t
    UNION ALL SELECT uid, 'https://gitlab.com/a/b' || uid, 'gitlab', CASE WHEN uid % 2 = 0 THEN 'abstract' ELSE 'fulltext' END FROM t""")
def _(spark, sf):
    got = K.classified(K.extract(said(spark, sf), "uid", "text"))
    both = got.withColumn("where", F.lit("fulltext")).unionByName(got.filter("uid % 2 = 0").withColumn("where", F.lit("abstract")))
    return K.paper_links(both).select("uid", "url", "kind", "where")


@query("link_own_code", "SELECT doc_id, doc_id % 4 < 2 AS own FROM documents")
def _(spark, sf):
    k = F.col("doc_id") % 4
    return table(spark, sf, "documents").select("doc_id", K.own_code(F.when(k == 0, "abstract").otherwise("fulltext"), F.when(k == 1, "Our code is at x").otherwise("tools at x"), r"(?i)\bour (?:code|scripts)\b").alias("own"))


@query("text_dois", "SELECT doc_id AS file, '10.1000/x' || doc_id AS doi, 'see doi 10.1000/X' || doc_id || ', or 10.1000/x' || doc_id || '.' AS context FROM documents")
def _(spark, sf):
    k = F.col("doc_id").cast("string")
    line = F.concat(F.lit("see  doi 10.1000/X"), k, F.lit(", or 10.1000/x"), k, F.lit(". "))
    return K.text_dois(table(spark, sf, "documents").select(F.col("doc_id").alias("file"), line.alias("line")), ["file"])


@query("reference_cut", "SELECT doc_id, CASE doc_id % 4 WHEN 3 THEN 'Body text' || chr(10) || 'references' || chr(10) || 'x' ELSE 'Body text' || chr(10) END AS text FROM documents")
def _(spark, sf):
    head = F.element_at(F.array(F.lit("## References and notes"), F.lit("References  "), F.lit("REFERENCES"), F.lit("references")), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, sf, "documents").select("doc_id", M.before_references(F.concat(F.lit("Body text\n"), head, F.lit("\nx"))).alias("text"))


@query("page_description", """SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'About ' || page_id WHEN 1 THEN 'Social & co' WHEN 2 THEN 'It''s “quoted” – é & 5 > 4' WHEN 3 THEN 'late name ' || page_id WHEN 4 THEN '' WHEN 5 THEN 'bare' ELSE '' END AS text FROM pages""")
def _(spark, sf):
    """Heads of the given pages with a description in every shape: its own, only the social one, references, any order and quotes, empty, none."""
    k = F.col("page_id").cast("string")
    shapes = [
        F.concat(F.lit('<meta property="og:description" content="Other"><META class="x" NAME="Description" content="About  '), k, F.lit('">')), F.lit('<meta property="og:description" content="Social &amp; co">'),
        F.lit('<meta name=\'description\' data-content="no" content=\'It&#39;s &ldquo;quoted&rdquo; &ndash; &eacute; &amp; 5 > 4\' />'), F.concat(F.lit('<meta content="late name '), k, F.lit('" name="description">')),
        F.lit('<meta name="description" content=""><meta property="og:description" content="unused">'), F.lit("<meta name=description content=bare>"), F.lit(""),
    ]
    added = F.coalesce(*[F.when(F.col("page_id") % 7 == i, x) for i, x in enumerate(shapes)])
    head = F.replace(F.col("html"), F.lit('<meta charset="utf-8">'), F.concat(F.lit('<meta charset="utf-8">'), added))
    return table(spark, sf, "pages").select("page_id", M.page_description(head).alias("text"))


def article_xml() -> F.Column:
    k = F.col("doc_id").cast("string")
    parts = [
        '<w xmlns:xlink="http://www.w3.org/1999/xlink"><article><front><journal-meta><journal-title>J</journal-title></journal-meta><article-meta><article-id pub-id-type="doi">10.1/', k, '</article-id><article-title>On <italic>x</italic>', k,
        '</article-title><contrib contrib-type="author"><name><surname>Doe</surname><given-names>Ann</given-names></name></contrib><license xlink:href="L"/><abstract><p>Short.</p></abstract><kwd>a</kwd><kwd>b</kwd></article-meta></front>',
        '<body><sec><title>One</title><p>See <ext-link xlink:href="http://u">here</ext-link>, <uri>http://v</uri> and <xref>2</xref>; H<sub>2</sub>O, <inline-formula> a + b </inline-formula>.</p><list list-type="order"><list-item><p>i</p></list-item><list-item><p>ii</p></list-item></list>',
        '<fig><label>Figure 1</label><caption><p>Cap.</p></caption><graphic xlink:href="f', k, '.g001"/></fig><table-wrap><label>T1</label><caption><p>Tab</p></caption><table><tr><th>h|1</th><th>h2</th></tr><tr><td>1</td></tr></table><graphic xlink:href="tab.GIF"/></table-wrap><disp-formula>e = m</disp-formula></sec></body>',
        "<back><ack><p>Thanks.</p></ack><ref-list><ref><label>7</label><mixed-citation>Roe B. Title. 2001.<pub-id pub-id-type=\"doi\">10.2/y</pub-id></mixed-citation></ref><ref><element-citation><name><surname>Poe</surname><given-names>C</given-names></name><article-title>Tale</article-title><year>1999</year><fpage>1</fpage><lpage>9</lpage></element-citation></ref></ref-list></back></article></w>",
    ]
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


NL = "' || chr(10) || chr(10) || '"


@query("article_markdown", f"""SELECT doc_id, '# On *x*' || doc_id || '{NL}Ann Doe{NL}J | doi:10.1/' || doc_id || ' | license: L{NL}## Abstract{NL}Short.{NL}**Keywords:** a; b{NL}## One{NL}See [here](http://u), http://v and 2; H~2~O, a + b .{NL}1. i' || chr(10) || '2. ii{NL}**Figure 1.** Cap.{NL}**T1** Tab{NL}| h\\|1 | h2 |'
    || chr(10) || '|---|---|' || chr(10) || '| 1 |  |{NL}    e = m{NL}## Acknowledgements{NL}Thanks.{NL}## References{NL}7. Roe B. Title. 2001.10.2/y' || chr(10) || '2. Poe C. Tale. 1999. 1-9' || chr(10) AS markdown FROM documents""")
def _(spark, sf):
    return X.markdown(table(spark, sf, "documents").select("doc_id", article_xml().alias("xml")), "doc_id", "xml").select("doc_id", "markdown")


@query("article_broken", f"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '#{NL}## One{NL}' || doc_id || ' cut in the' || chr(10) WHEN 1 THEN '#{NL}## One{NL}**a** b{NL}c & d – < 5' || chr(10)
    WHEN 2 THEN '#{NL}one *two* **three**{NL}four' || chr(10) ELSE '' END AS markdown FROM documents""")
def _(spark, sf):
    """XML that ends too early, has ends without beginnings, crossing elements, or is none: its text stays."""
    k = F.col("doc_id")
    xml = F.when(k % 4 == 0, F.concat(F.lit("<article><body><sec><title>One</title><p>"), k.cast("string"), F.lit(" cut in the"))).when(k % 4 == 1, "<article><body><sec><title>One</title></bold><p><bold>a</bold> b</p><p>c & d &ndash; < 5</sec></x></body></article>")
    xml = xml.when(k % 4 == 2, "<w><article><body><p>one <italic>two</italic> <bold>three</p><p>four</bold></p></article>").otherwise("no element & nothing else")
    return X.markdown(table(spark, sf, "documents").select("doc_id", xml.alias("xml")), "doc_id", "xml").select("doc_id", "markdown")


@query("article_front", "SELECT doc_id, 'On *x*' || doc_id AS title, 'Ann Doe' AS author, 'J' AS journal, '10.1/' || doc_id AS doi FROM documents")
def _(spark, sf):
    m = X.markdown(table(spark, sf, "documents").select("doc_id", article_xml().alias("xml")), "doc_id", "xml")
    at = lambda p: F.get_json_object("front", p)
    return m.select("doc_id", at("$.title").alias("title"), at("$.authors[0]").alias("author"), at("$.journal").alias("journal"), at("$.doi").alias("doi"))


@query("markdown_plain", "SELECT doc_id, 'Head' || chr(10) || 'bold and it, see x (http://u) a_b' || chr(10) || 'c1' || chr(9) || 'c2' || chr(10) AS text FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.markdown_text(F.lit("## Head\n**bold** and *it*, see [x](http://u) a_b\n| c1 | c2 |\n")).alias("text"))


@query("caption_join", """SELECT doc_id, f.file, f.kind, f.label, f.caption FROM documents, LATERAL (VALUES ('f' || doc_id || '.g001.jpg', 'figure', 'Figure 1', 'Cap.'), ('tab.gif', 'table', 'T1', 'Tab'), ('other.png', 'figure', '', ''), ('data.csv', 'supplementary', '', '')) f(file, kind, label, caption)""")
def _(spark, sf):
    d = table(spark, sf, "documents")
    found = X.caption_map(d.select("doc_id", article_xml().alias("xml")), "doc_id", "xml")
    names = F.explode(F.array(F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".g001.jpg")), F.lit("tab.gif"), F.lit("other.png"), F.lit("data.csv")))
    return X.described(d.select("doc_id", names.alias("file")), found, "doc_id").select("doc_id", "file", "kind", "label", "caption")


# ---------------------------------------------------------------- classification, joins, merging


@query("classify_species", f"WITH {PAPERS} SELECT uid, CASE WHEN k % 3 = 0 OR regexp_matches(abstract, 'que', 'i') THEN CASE WHEN regexp_matches(abstract, 'der', 'i') THEN 'human; mouse' ELSE 'human' END WHEN regexp_matches(abstract, 'der', 'i') THEN 'mouse' ELSE '' END AS species FROM papers")
def _(spark, sf):
    return papers(spark, sf).select("uid", F.array_join(C.all_matches(F.col("abstract"), {"mouse": "der", "human": "que"}, "human", F.col("k") % 3 == 0), "; ").alias("species"))


@query("classify_entities", r"SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(text, '(^|[^\p{L}\p{M}\p{Nd}\p{Pc}-])The([^\p{L}\p{M}\p{Nd}\p{Pc}-]|$)') THEN 'The' END, CASE WHEN regexp_matches(text, '(^|[^\p{L}\p{M}\p{Nd}\p{Pc}-])der([^\p{L}\p{M}\p{Nd}\p{Pc}-]|$)', 'i') THEN 'der' END], lambda x: x IS NOT NULL), '; ') AS entities FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(C.entities(F.col("text"), {"The": "The", "der": "(?i)der"}), "; ").alias("entities"))


@query("classify_origin", f"WITH {PAPERS} SELECT uid, CASE WHEN k % 11 = 0 THEN 'method development' WHEN resource_type = 'review' THEN 'review' WHEN regexp_matches(title, '^the', 'i') THEN 'titled' ELSE 'other' END AS category FROM papers")
def _(spark, sf):
    rules = [{"name": "review", "pub_types": "review"}, {"name": "titled", "title": "^the"}]
    return papers(spark, sf).select("uid", C.category(rules, F.col("resource_type"), F.col("title"), F.col("abstract"), "other", F.col("k") % 11 == 0).alias("category"))


@query("catalogue_joins", f"""WITH {PAPERS} SELECT uid, fulltext_status, CASE WHEN fulltext_status IN ('ok', 'partial') THEN 'yes' WHEN k % 2 = 0 THEN 'no' ELSE 'unknown' END AS open_access,
    CASE WHEN k % 4 = 0 THEN 'fulltext/' || k || '/paper.md' ELSE '' END AS fulltext_md, CASE WHEN k % 3 = 0 THEN '1/2: jpg 1, xlsx 1' ELSE '' END AS attachments, CASE WHEN k % 5 = 0 THEN 5000 ELSE CAST(cited_by AS INTEGER) END AS cited_by,
    CASE WHEN k % 6 = 0 AND doi <> '' THEN 'published as 10.9/' || k ELSE '' END AS related, CASE WHEN k % 4 = 1 THEN 'https://a.b/' || k || '; https://c.d/' || k ELSE '' END AS code_links FROM (SELECT * REPLACE (CASE WHEN k % 2 = 0 THEN fulltext_status ELSE '' END AS fulltext_status) FROM papers)""")
def _(spark, sf):
    c, p = F.col, papers(spark, sf)
    k = c("k").cast("string")
    blank = ["pub_date", "pub_year", "pub_types", "source_db", "mesh", "url", "license", "related_doi"]
    rec = p.select("uid", "title", "abstract", "doi", "pmid", "keywords", "authors", "cited_by", c("venue").alias("journal"), F.lit(False).alias("is_preprint"), F.lit(False).alias("is_open_access"), *[F.lit("").alias(b) for b in blank])
    hits = p.limit(0).select("uid", c("title").alias("group"), c("title").alias("scope"), c("venue").alias("source"))
    seeds = p.limit(0).select("doi", c("title").alias("source_repo"), c("title").alias("role"), c("title").alias("registry_id"))
    full = p.filter("k % 2 = 0").select("uid", c("fulltext_status").alias("status"), F.concat(F.lit("fulltext/"), k).alias("folder"), F.lit("").alias("license"), F.when(c("k") % 4 == 0, "True").otherwise("False").alias("has_md"))
    files = p.filter("k % 3 = 0").select("uid", F.explode(F.array(F.struct(F.lit("a.jpg").alias("file"), F.lit("jpg").alias("ext"), F.lit("ok").alias("status")), F.struct(F.lit("b").alias("file"), F.lit("XLSX").alias("ext"), F.lit("listed").alias("status")))).alias("f")).select("uid", "f.*")
    links = p.filter("k % 4 = 1").select("uid", F.posexplode(F.array(F.concat(F.lit("https://a.b/"), k), F.concat(F.lit("https://c.d/"), k), F.concat(F.lit("https://a.b/"), k))).alias("pos", "url"))
    cites = p.filter("k % 5 = 0").select("uid", F.lit("5000").alias("cited_by"), F.lit("").alias("publication_date"))
    pairs = p.filter("k % 6 = 0 AND doi <> ''").select(c("doi").alias("preprint_doi"), F.concat(F.lit("10.9/"), k).alias("published_doi"), c("k").alias("seq"))
    rows = A.catalogue_rows(rec, hits, seeds, {}, "2011-01-01", TODAY, fulltext=full, attachments=files, links=links, citations=cites, pairs=pairs)
    return rows.select("uid", "fulltext_status", "open_access", "fulltext_md", "attachments", c("cited_by").cast("int").alias("cited_by"), "related", "code_links")


@query("reference_fields", f"WITH {PAPERS} SELECT uid, CASE WHEN k % 2 = 0 THEN 'Full Name, Other' ELSE authors END AS authors, CASE WHEN k % 2 = 0 THEN '12' ELSE '' END AS volume FROM papers")
def _(spark, sf):
    p = papers(spark, sf)
    rec = p.filter("k % 2 = 0").select("uid", F.lit("Full Name, Other").alias("authors"), F.lit("V").alias("venue"), F.lit("12").alias("volume"), F.lit("").alias("issue"), F.lit(None).cast("string").alias("pages"))
    return A.with_references(p, rec).select("uid", "authors", "volume")


@query("unknown_only", "SELECT doc_id FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 5 <> 0")
def _(spark, sf):
    d = table(spark, sf, "documents")
    k = F.col("doc_id").cast("string")
    aliases = d.filter("doc_id % 3 = 0").select(F.concat(F.lit("pmid:"), k).alias("alias"), k.alias("target")).unionByName(d.filter("doc_id % 5 = 0").select(F.concat(F.lit("MED/"), k).alias("alias"), k.alias("target")))
    return C.unknown(d.select(k.alias("uid"), F.array(F.concat(F.lit("pmid:"), k), F.concat(F.lit("MED/"), k)).alias("keys"), "doc_id"), aliases).select("doc_id")


@query("hit_scope", """SELECT user_id AS uid, event_type AS "group", 'events' AS source, strftime(min(ts), '%Y-%m-%d') AS first_seen, strftime(max(ts), '%Y-%m-%d') AS last_seen, min(CASE WHEN value > 50 THEN 'focused' ELSE 'broad' END) FILTER (strftime(ts, '%Y-%m-%d') = lo) AS scope
    FROM (SELECT *, min(strftime(ts, '%Y-%m-%d')) OVER (PARTITION BY user_id, event_type) AS lo FROM events) GROUP BY 1, 2""")
def _(spark, sf):
    day = F.date_format("ts", "yyyy-MM-dd")
    e = table(spark, sf, "events").select(F.col("user_id").alias("uid"), F.col("event_type").alias("group"), F.lit("events").alias("source"), day.alias("first_seen"), day.alias("last_seen"), F.when(F.col("value") > 50, "focused").otherwise("broad").alias("scope"))
    return C.merge_hits(e)


@query("work_versions", "WITH w AS (SELECT doc_id, doc_id // 3 AS work_key FROM documents) SELECT doc_id AS uid, CASE WHEN work_key % 4 = 0 THEN work_key + 1000000 ELSE min(doc_id) OVER (PARTITION BY work_key) END AS as_uid FROM w QUALIFY doc_id <> as_uid")
def _(spark, sf):
    w = table(spark, sf, "documents").select(F.col("doc_id").alias("uid"), F.floor(F.col("doc_id") / 3).alias("work_key"))
    stored = w.filter("work_key % 4 = 0").select("work_key", (F.col("work_key") + 1000000).alias("uid")).distinct()
    return C.new_works(w, stored, ["uid"])[1]


@query("work_fresh", "SELECT min(doc_id) AS uid, doc_id // 3 AS work_key FROM documents GROUP BY 2 HAVING work_key % 4 <> 0")
def _(spark, sf):
    w = table(spark, sf, "documents").select(F.col("doc_id").alias("uid"), F.floor(F.col("doc_id") / 3).alias("work_key"))
    return C.new_works(w, w.filter("work_key % 4 = 0").select("work_key", "uid"), ["uid"])[0]


@query("id_union", "SELECT doc_id FROM documents WHERE doc_id % 2 = 0 UNION SELECT doc_id FROM documents WHERE doc_id % 3 = 0")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    return C.id_union([d.filter("doc_id % 2 = 0"), d.filter("doc_id % 3 = 0"), d.filter("doc_id % 6 = 0")])


@query("set_difference", "SELECT doc_id, list_sort(list_filter(['arxiv', 'pmc', 'unpaywall'], lambda x: x <> CASE doc_id % 3 WHEN 0 THEN 'pmc' WHEN 1 THEN 'arxiv' ELSE '-' END)) AS missing, CASE doc_id % 3 WHEN 0 THEN ['pmc'] WHEN 1 THEN ['arxiv', 'pmc'] ELSE [] END AS tried FROM documents")
def _(spark, sf):
    k = F.col("doc_id") % 3
    there = F.when(k == 0, F.array(F.lit("pmc"))).when(k == 1, F.array(F.lit("arxiv"))).otherwise(F.array().cast("array<string>"))
    said_ = F.when(k == 0, "pmc, old").when(k == 1, "pmc,arxiv").otherwise("")
    return table(spark, sf, "documents").select("doc_id", U.missing(F.array(F.lit("arxiv"), F.lit("pmc"), F.lit("unpaywall")), there).alias("missing"), U.tried_sources(said_, ["arxiv", "pmc", "unpaywall"]).alias("tried"))


@query("seed_unique", "SELECT 'd' || l_partkey % 50 AS doi, l_linestatus AS role, 'f' || l_linenumber % 2 AS source_file, '' AS registry_id, min('c' || l_orderkey) AS context FROM lineitem GROUP BY 1, 2, 3")
def _(spark, sf):
    t = lambda *parts: F.concat(*parts)
    s = table(spark, sf, "lineitem").select(t(F.lit("d"), (F.col("l_partkey") % 50).cast("string")).alias("doi"), F.col("l_linestatus").alias("role"), t(F.lit("f"), (F.col("l_linenumber") % 2).cast("string")).alias("source_file"), F.lit("").alias("registry_id"), t(F.lit("c"), F.col("l_orderkey").cast("string")).alias("context"))
    return Y.unique_seeds(s)


# ---------------------------------------------------------------- scope, order, analytics


@query("update_scope", f"WITH {PAPERS} SELECT uid FROM papers WHERE resource_type IN ('article', 'preprint') AND tier IN ('landmark', 'core') AND CASE WHEN date = '' THEN '0000' ELSE date END <= '2018-12-31' AND k % 2 = 0")
def _(spark, sf):
    p = papers(spark, sf)
    return U.scoped(p, "landmark,core", "article, preprint,website", p.filter("k % 2 = 0").select("uid"), date_to="2018-12-31").select("uid")


@query("download_priority", f"WITH {PAPERS} SELECT uid, row_number() OVER (ORDER BY CASE tier WHEN 'landmark' THEN 0 WHEN 'core' THEN 1 ELSE 2 END, CAST(cited_by AS INTEGER) DESC, uid) AS n FROM papers")
def _(spark, sf):
    from quarrylark.operators.ordering import running_number

    return running_number(papers(spark, sf).select("uid", "tier", "cited_by"), [*U.priority(), "uid"]).select("uid", "n")


@query("catalogue_places", f"WITH {PAPERS} SELECT uid, row_number() OVER (ORDER BY CASE WHEN date = '' THEN '9999' ELSE date END, CASE tier WHEN 'landmark' THEN 0 WHEN 'core' THEN 1 ELSE 2 END, k % 10, uid) AS n FROM papers")
def _(spark, sf):
    from quarrylark.operators.ordering import running_number

    p = papers(spark, sf).withColumn("title", (F.col("k") % 10).cast("string"))
    return running_number(p, C.catalogue_keys()).select("uid", "n")


@query("sort_author", f"WITH {PAPERS} SELECT uid FROM papers ORDER BY CASE k % 3 WHEN 0 THEN 'smith' WHEN 1 THEN 'anon' ELSE 'zed' END, uid LIMIT 100")
def _(spark, sf):
    return C.select(papers(spark, sf).withColumn("title", F.lit("Anon")), sort="author", limit=100).select("uid")


@query("report_page", f"WITH {PAPERS} SELECT uid, cited_by FROM papers ORDER BY CAST(cited_by AS INTEGER) DESC, uid LIMIT 20 OFFSET 20")
def _(spark, sf):
    return O.page(papers(spark, sf), "cited_by", descending=True, number=2, size=20).select("uid", "cited_by")


@query("report_search", f"WITH {PAPERS} SELECT uid FROM papers WHERE contains(lower(venue || ' ' || entities), 'src1') AND contains(lower(venue || ' ' || entities), 'grim') AND tier = 'core'")
def _(spark, sf):
    return O.search(papers(spark, sf), "SRC1 grim", ["venue", "entities"], tier="core", modality="").select("uid")


@query("newest_rows", f"WITH {PAPERS} SELECT date, uid FROM papers ORDER BY date DESC, uid LIMIT 10")
def _(spark, sf):
    return O.newest(papers(spark, sf))


@query("layers_over_time", f"WITH {PAPERS} SELECT year, trim(m) AS layer, count(*) AS papers FROM papers, unnest(string_split(modality, ';')) u(m) WHERE trim(m) <> '' AND tier IN ('landmark', 'core') AND resource_type IN ('article', 'review', 'preprint') GROUP BY 1, 2")
def _(spark, sf):
    return O.layers_over_time(papers(spark, sf))


@query("pivot_year_modality", f"""WITH {PAPERS}, m AS (SELECT year, trim(m) AS m FROM papers, unnest(string_split(modality, ';')) u(m)) SELECT year, count(*) FILTER (m = 'Proteome') AS "Proteome", count(*) FILTER (m = 'DNA methylation') AS "DNA methylation",
    count(*) FILTER (m = 'Microbiome') AS "Microbiome", count(*) FILTER (m = 'Transcriptome') AS "Transcriptome", count(*) FILTER (m = 'transcriptome') AS "transcriptome_low" FROM m WHERE m <> '' GROUP BY 1""")
def _(spark, sf):
    each = papers(spark, sf).select("year", F.explode(S.list_items(F.col("modality"))).alias("m")).withColumn("m", F.when(F.col("m") == "transcriptome", "transcriptome_low").otherwise(F.col("m")))
    return each.groupBy("year").pivot("m", C.by_frequency(each, "m")).count().na.fill(0)


@query("entity_mentions", f"WITH {PAPERS}, e AS (SELECT trim(e) AS entity FROM papers, unnest(string_split(regexp_replace(entities, '^[^;]* registry: [^;]*;?', ''), ';')) u(e)) SELECT entity, count(*) AS n FROM e WHERE entity <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 60")
def _(spark, sf):
    return O.entity_mentions(papers(spark, sf))


@query("origin_timeline", f"WITH {PAPERS} SELECT date, uid, 'list: c' || k || ', d' AS ids FROM papers WHERE k % 6 = 1")
def _(spark, sf):
    return O.origin_timeline(papers(spark, sf))


@query("report_tiles", f"""WITH {PAPERS}, p AS (SELECT *, resource_type IN ('article', 'review', 'preprint') AS paper FROM papers) SELECT count(*) AS rows, count(*) FILTER (added_on = '2024-03-15') AS added, count(*) FILTER (paper) AS papers, count(*) FILTER (paper AND summary_from = 'abstract') AS with_abstract,
    count(*) FILTER (paper AND fulltext_status = 'ok') AS ok, count(*) FILTER (paper AND fulltext_status = 'none') AS missing, count(*) FILTER (pending <> '') AS pending, count(*) FILTER (resource_type = 'dataset') AS code, count(*) FILTER (resource_type = 'website') AS sites,
    CAST(sum(CASE k % 8 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END) AS BIGINT) AS links FROM p""")
def _(spark, sf):
    return O.tiles(papers(spark, sf), "2024-03-15")


@query("status_reasons", "SELECT CASE o_orderkey % 3 WHEN 0 THEN 'no open copy' ELSE 'timeout' END AS reason, count(*) AS n FROM orders GROUP BY 1")
def _(spark, sf):
    k = F.col("o_orderkey")
    return O.reasons(table(spark, sf, "orders").select(F.when(k % 3 == 0, "no open copy (tried: pmc, unpaywall)").when(k % 3 == 1, "timeout").otherwise("timeout (2)").alias("reason")))


@query("last_builds", "SELECT * FROM (SELECT strftime(o_orderdate, '%Y-%m-%d') AS run_date, o_orderkey AS rows_total FROM orders ORDER BY 1 DESC, 2 DESC LIMIT 5)")
def _(spark, sf):
    return O.last_builds(table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("run_date"), F.col("o_orderkey").alias("rows_total")))


@query("run_statistics", f"WITH {PAPERS} SELECT '2024-03-15' AS run_date, '2024-06-01' AS window_end, count(*) AS rows_total, count(*) FILTER (added_on = '2024-03-15') AS rows_added, count(*) FILTER (k % 5 = 4) AS rows_kept_unmatched FROM papers")
def _(spark, sf):
    p = papers(spark, sf).withColumn("status", F.when(F.col("k") % 5 == 4, "not matched in the last run").otherwise(""))
    return Z.run_row(p, "2024-03-15", "2024-06-01")


@query("day_changes", "SELECT doc_id AS uid, CASE WHEN doc_id % 2 = 0 THEN 'later' ELSE 'earlier' END AS status FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0")
def _(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("uid"))
    return Z.day_changes(d.filter("uid % 3 = 0").withColumn("status", F.lit("earlier")), d.filter("uid % 2 = 0").withColumn("status", F.lit("later")))


@query("snapshot_read", "SELECT doc_id AS uid, 'second' AS run FROM documents")
def _(spark, sf):
    root = scratch(spark, "snapshots")
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("uid"))
    Z.commit(d.withColumn("run", F.lit("first")), root, 0)
    Z.commit(Z.read(spark, root).withColumn("run", F.lit("second")), root, 1)
    return Z.read(spark, root)


# ---------------------------------------------------------------- repositories and sites


@query("repository_links", """SELECT 'o/r' || l_partkey % 100 AS repo, array_to_string(list_sort(list(DISTINCT 'p' || l_suppkey)), '; ') AS papers, '' AS folders, bool_or(l_linestatus = 'F') AS own_code, false AS registry FROM lineitem GROUP BY 1
    UNION ALL SELECT 'local/x', '', 'a; b', false, true""")
def _(spark, sf):
    url = F.concat(F.lit("https://www.GitHub.com/O/R"), (F.col("l_partkey") % 100).cast("string"), F.lit(".git"))
    own = table(spark, sf, "lineitem").select(P.repository_key(url).alias("repo"), F.concat(F.lit("p"), F.col("l_suppkey").cast("string")).alias("uid"), (F.col("l_linestatus") == "F").alias("own"))
    local = spark.createDataFrame([("local/x", "b", False), ("local/x", "a", True), ("local/x", "a", False)], "repo string, folder string, registry boolean")
    return P.gathered(own, local)


@query("repository_search", """WITH h AS (SELECT 'Org/R' || user_id AS full_name, event_type AS query, strftime(ts, '%Y-%m-%d') AS run, event_id AS seq, CAST(value AS VARCHAR) AS stars FROM events)
    SELECT full_name, arg_max(stars, seq) AS stars, array_to_string(list_sort(list(DISTINCT query)), '; ') AS queries, min(run) AS first_seen, max(run) AS last_seen FROM h GROUP BY 1""".replace("CAST(value AS VARCHAR)", "CAST(event_id % 97 AS VARCHAR)"))
def _(spark, sf):
    e = table(spark, sf, "events")
    name = F.concat(F.when(F.col("event_id") == -1, "org").otherwise("Org"), F.lit("/R"), F.col("user_id").cast("string"))
    return P.searched(e.select(name.alias("full_name"), F.col("event_type").alias("query"), F.date_format("ts", "yyyy-MM-dd").alias("run"), F.col("event_id").alias("seq"), (F.col("event_id") % 97).cast("string").alias("stars")))


@query("release_span", "SELECT l_partkey AS name, strftime(min(l_shipdate), '%Y-%m-%d') AS created, strftime(max(l_shipdate), '%Y-%m-%d') AS updated FROM lineitem GROUP BY 1")
def _(spark, sf):
    return P.releases(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("name"), F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss").alias("uploaded")))


@query("release_first_month", "SELECT l_suppkey AS name, strftime(min(l_shipdate), '%Y-%m') || '-01' AS created FROM lineitem WHERE l_linenumber > 1 GROUP BY 1")
def _(spark, sf):
    i = table(spark, sf, "lineitem")
    return P.first_month(i.select(F.col("l_suppkey").alias("name"), F.year("l_shipdate").alias("year"), F.date_format("l_shipdate", "MMM").alias("month"), (F.col("l_linenumber") - 1).alias("n")).unionByName(i.limit(3).select(F.col("l_suppkey").alias("name"), F.lit(1900).alias("year"), F.lit("all").alias("month"), F.lit(9).alias("n"))))


@query("repository_cache", """SELECT 'O/r' || doc_id AS name, CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN '7' END AS stars, doc_id % 3 = 1 AND doc_id % 2 = 0 AS missing, NOT (doc_id % 3 < 2 AND doc_id % 2 = 0) AS to_fetch FROM documents""")
def _(spark, sf):
    k, n = F.col("doc_id"), F.col("doc_id").cast("string")
    d = table(spark, sf, "documents")
    cache = d.filter("doc_id % 3 < 2").select(F.concat(F.lit("o/R"), n).alias("name"), F.when(k % 2 == 0, "2024-05-20").otherwise("2024-04-01").alias("checked_on"), F.when(k % 3 == 0, "2015-01-01").otherwise("").alias("created"), F.when(k % 3 == 1, "repository gone").otherwise("").alias("reason"), F.lit("7").alias("stars"))
    return P.remembered(d.select(F.concat(F.lit("O/r"), n).alias("name")), cache, TODAY, ["stars"]).select("name", "stars", "missing", "to_fetch")


@query("repository_papers", """SELECT 'r' || l_partkey % 40 AS repo, bool_or(o_orderstatus = 'F') AS core_papers, array_to_string(list_sort(list(DISTINCT 'ord:' || l_orderkey)), '; ') AS papers FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1""")
def _(spark, sf):
    uid = lambda c: F.concat(F.lit("ord:"), F.col(c).cast("string")).alias("uid")
    links = table(spark, sf, "lineitem").select(F.concat(F.lit("r"), (F.col("l_partkey") % 40).cast("string")).alias("repo"), uid("l_orderkey"), F.lit(False).alias("own"))
    cat = table(spark, sf, "orders").select(uid("o_orderkey"), F.when(F.col("o_orderstatus") == "F", "core").otherwise("related").alias("tier"), F.lit("").alias("doi"))
    return I.linked_papers(links, cat).select("repo", "core_papers", "papers")


@query("site_recheck", "SELECT 'd' || page_id || '.org' AS domain, 'https://d' || page_id || '.org/' AS url, page_id % 7 AS n_papers, page_id % 2 = 0 AS to_fetch, CASE WHEN page_id % 2 = 1 THEN '200' END AS status FROM pages WHERE page_id % 7 >= 3")
def _(spark, sf):
    p, k = table(spark, sf, "pages"), F.col("page_id")
    url = F.concat(F.lit("https://d"), k.cast("string"), F.lit(".org/"))
    old = p.select(url.alias("url"), F.when(k % 2 == 0, "2024-01-01").otherwise("2024-05-20").alias("checked_on"), F.lit("200").alias("status"), F.lit("").alias("page_title"), F.lit("").alias("page_description")).filter(k % 4 != 2)
    found = p.select(F.concat(F.lit("d"), k.cast("string"), F.lit(".org")).alias("domain"), (k % 7).alias("n_papers"))
    return I.candidates_to_check(found, old, "2024-05-02").select("domain", "url", "n_papers", F.coalesce("to_fetch", F.lit(True)).alias("to_fetch"), "status")


@query("package_rows", "SELECT 'pkg' || p_partkey AS name, 'https://pypi.org/project/pkg' || p_partkey || '/' AS url, lower(p_name) AS description, '2019-02-03' AS created, '2021-05-06' AS updated FROM part")
def _(spark, sf):
    p = table(spark, sf, "part")
    up = lambda d: F.struct(F.lit(d).alias("upload_time"))
    body = F.struct(F.struct(F.concat(F.lit("pkg"), F.col("p_partkey").cast("string")).alias("name"), F.lower("p_name").alias("summary")).alias("info"), F.create_map(F.lit("1.0"), F.array(up("2021-05-06T01:00:00"), up("2020-01-01T00:00:00")), F.lit("0.1"), F.array(up("2019-02-03T00:00:00"))).alias("releases"))
    return P.index_packages(p.select(F.to_json(body).alias("value")), "pypi").select("name", "url", "description", "created", "updated")


@query("repository_rows", "SELECT 'Org/r' || p_partkey AS full_name, p_size AS stars, '2019-02-03' AS created, 'x; y' AS topics, p_partkey % 9 = 0 AS fork FROM part")
def _(spark, sf):
    p = table(spark, sf, "part")
    item = F.struct(F.concat(F.lit("Org/r"), F.col("p_partkey").cast("string")).alias("full_name"), F.col("p_size").alias("stargazers_count"), F.lit("2019-02-03T00:00:00Z").alias("created_at"), F.array(F.lit("x"), F.lit("y")).alias("topics"), (F.col("p_partkey") % 9 == 0).alias("fork"))
    k = F.col("p_partkey") % 2 == 0  # half of them as hits of a search, half as look-ups
    both = p.select(F.when(k, F.to_json(F.struct(F.array(item).alias("items")))).otherwise(F.to_json(item)).alias("value"))
    return P.repositories(both).select("full_name", F.col("stars").cast("int").alias("stars"), "created", "topics", "fork")


# ---------------------------------------------------------------- records, look-ups, sources and sinks


@query("records_pubmed", "SELECT 'doi:10.1234/d' || doc_id AS uid, 'Title ' || doc_id AS title, 'Doe AB, The Group' AS authors, '2020-03-01' AS pub_date, CAST(doc_id + 1 AS VARCHAR) AS pmid FROM documents")
def _(spark, sf):
    k = F.col("doc_id").cast("string")
    xml = F.concat(F.lit("<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>"), (F.col("doc_id") + 1).cast("string"), F.lit("</PMID><Article><Journal><Title>J</Title><JournalIssue><PubDate><Year>2020</Year><Month>Mar</Month></PubDate></JournalIssue></Journal><ArticleTitle>Title "), k, F.lit("</ArticleTitle><AuthorList><Author><LastName>Doe</LastName><Initials>AB</Initials></Author><Author><CollectiveName>The Group</CollectiveName></Author></AuthorList></Article></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType=\"doi\">10.1234/D"), k, F.lit("</ArticleId></ArticleIdList></PubmedData></PubmedArticle></PubmedArticleSet>"))
    return records.pubmed(table(spark, sf, "documents").select(xml.alias("value"))).select("uid", "title", "authors", "pub_date", "pmid")


@query("records_feed", "SELECT 'doi:10.48550/arxiv.2001.' || doc_id AS uid, 'T' AS title, 'Ann Doe' AS authors, '2020-01-05' AS pub_date FROM documents WHERE doc_id % 2 = 0")
def _(spark, sf):
    k = F.col("doc_id")
    xml = F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/2001.'), k.cast("string"), F.lit("v2</id><title>T</title><author><name>Ann Doe</name></author><published>"), F.when(k % 2 == 0, "2020-01-05").otherwise("2019-01-05"), F.lit("T00:00:00Z</published><summary>s</summary></entry></feed>"))
    return records.preprint_feed(table(spark, sf, "documents").select(xml.alias("value")), "2020-01-01").select("uid", "title", "authors", "pub_date")


@query("records_open_works", "SELECT 'doi:10.1234/d' || doc_id AS uid, 'T ' || doc_id AS title, 'A B, C D' AS authors, lang || ' words here' AS abstract FROM documents".replace("'A B, C D'", "'A B, C D'"))
def _(spark, sf):
    k = F.col("doc_id").cast("string")
    person = lambda n: F.struct(F.struct(F.lit(n).alias("display_name")).alias("author"))
    body = F.struct(F.concat(F.lit("https://doi.org/10.1234/D"), k).alias("doi"), F.lit("article").alias("type"), F.concat(F.lit("T "), k).alias("title"), F.lit("2020-01-02").alias("publication_date"), F.array(person("A B"), person("C D")).alias("authorships"), F.create_map(F.lit("here"), F.array(F.lit(2)), F.col("lang"), F.array(F.lit(0)), F.lit("words"), F.array(F.lit(1))).alias("abstract_inverted_index"))
    got = records.open_works(table(spark, sf, "documents").select(F.to_json(body).alias("value")))
    return got.select("uid", "title", F.regexp_replace("authors", "; ", ", ").alias("authors"), "abstract")


@query("records_registry", "SELECT 'doi:10.1234/d' || doc_id AS uid, 'T' AS title, 'Doe AB' AS authors, '2019-05-01' AS pub_date, 'Venue' AS journal FROM documents")
def _(spark, sf):
    k = F.col("doc_id").cast("string")
    day = lambda *p: F.struct(F.array(F.array(*[F.lit(x) for x in p])).alias("date-parts"))
    m = F.struct(F.concat(F.lit("10.1234/D"), k).alias("DOI"), F.lit("journal-article").alias("type"), F.array(F.lit("T")).alias("title"), F.array(F.lit("Venue")).alias("container-title"), F.array(F.struct(F.lit("Doe").alias("family"), F.lit("Ann-Bo").alias("given"))).alias("author"), day(2020, 1, 2).alias("published-print"), day(2019, 5).alias("published-online"))
    return records.registry_works(table(spark, sf, "documents").select(F.to_json(F.struct(m.alias("message"))).alias("value"))).select("uid", "title", "authors", "pub_date", "journal")


@query("fulltext_cascade", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'x' WHEN doc_id % 3 = 0 THEN 'y' ELSE '' END AS xml, CASE WHEN doc_id % 2 = 0 THEN 'pmc' WHEN doc_id % 3 = 0 THEN 'arxiv' ELSE '' END AS xml_source, 'p' AS pdf, 'arxiv' AS pdf_source FROM documents")
def _(spark, sf):
    k = F.col("doc_id")
    d = table(spark, sf, "documents").select("doc_id", F.when(k % 2 == 0, "x").alias("pmc_xml"), F.when(k % 3 == 0, "y").otherwise("").alias("arxiv_xml"), F.lit("").alias("pmc_pdf"), F.lit("p").alias("arxiv_pdf"))
    return records.first_copy(d, ["pmc", "arxiv"]).select("doc_id", "xml", "xml_source", "pdf", "pdf_source")


@query("lookup_requests", f"WITH {PAPERS} SELECT doi FROM papers WHERE doi <> ''")
def _(spark, sf):
    r = lookups.requests(papers(spark, sf).select("doi").unionByName(spark.createDataFrame([("10.1/a|b",), ("10.1000/1",), ("",)], "doi string")))
    each = r.select(F.split(F.substr("filter", F.lit(5)), "[|]").alias("d"))
    return each.select(F.when(F.size("d") > 50, F.raise_error(F.lit("too many"))).otherwise(F.lit(0)).alias("z"), F.explode("d").alias("doi")).filter("z = 0").select("doi").distinct()


@query("lookup_citations", f"WITH {PAPERS} SELECT uid, CASE WHEN k % 2 = 0 THEN k + 1 ELSE 3 END AS cited_by, CASE WHEN k % 2 = 0 THEN '2024-06-01' ELSE '2020-01-01' END AS checked_on FROM papers WHERE doi <> ''")
def _(spark, sf):
    p = papers(spark, sf).filter("doi <> ''")
    w = F.struct(F.lit("W").alias("id"), F.concat(F.lit("https://doi.org/"), F.upper("doi")).alias("doi"), (F.col("k") + 1).alias("cited_by_count"))
    answers = p.filter("k % 2 = 0").select(F.to_json(F.struct(F.array(w).alias("results"))).alias("value"))
    old = p.select("uid", "doi", F.lit(3).cast("long").alias("cited_by"), *[F.lit("").alias(c) for c in ("publication_date", "oa_status", "oa_url", "openalex_id")], F.lit("2020-01-01").alias("checked_on"))
    return lookups.citations(answers, p, old, TODAY).select("uid", "cited_by", "checked_on")


@query("lookup_preprints", "SELECT '10.1101/' || doc_id AS preprint_doi FROM documents WHERE doc_id % 4 = 0 OR doc_id % 4 = 1")
def _(spark, sf):
    k, d = F.col("doc_id"), table(spark, sf, "documents")
    doi = F.concat(F.lit("10.1101/"), k.cast("string"))
    known = d.filter("doc_id % 4 > 0").select(doi.alias("preprint_doi"), F.when(k % 4 == 2, "10.9/x").otherwise("").alias("published_doi"), F.when(k % 4 == 1, "2024-01-01").otherwise("2024-05-20").alias("checked_on"))
    return lookups.preprints_due(d.select(doi.alias("doi")), known, TODAY)


@query("lookup_published", "SELECT '10.1101/' || doc_id AS preprint_doi, CASE doc_id % 3 WHEN 0 THEN 'biorxiv' WHEN 1 THEN 'medrxiv' ELSE '' END AS server, CASE WHEN doc_id % 3 < 2 THEN '10.1234/p' ELSE '' END AS published_doi, '2024-06-01' AS checked_on FROM documents")
def _(spark, sf):
    k = F.col("doc_id")
    doi = F.concat(F.lit("10.1101/"), k.cast("string")).alias("preprint_doi")
    d = table(spark, sf, "documents")
    full = '{"collection":[{"published":"NA"},{"published":"10.1234/P"},{"published":"NA"}]}'
    one = d.select(doi, F.lit("biorxiv").alias("server"), F.when(k % 3 == 0, full).otherwise('{"collection":[]}').alias("value"))
    two = d.select(doi, F.lit("medrxiv").alias("server"), F.when(k % 3 == 1, full).otherwise('{"messages":[]}').alias("value"))
    return lookups.published(one.unionByName(two), TODAY)


@query("store_listing", "SELECT 'PMC' || doc_id AS pmcid, 2 AS version, 'fig.jpg' AS name, 5 AS bytes FROM documents")
def _(spark, sf):
    k = F.col("doc_id").cast("string")
    names = F.array(*[F.struct(F.concat(F.lit("PMC"), k, F.lit(f".{v}/"), n).alias("key"), F.lit(5).alias("size")) for v, n in ((1, F.concat(F.lit("PMC"), k, F.lit(".1.json"))), (2, F.concat(F.lit("PMC"), k, F.lit(".2.json"))), (2, F.lit("fig.jpg")), (2, F.lit("sub/x.jpg")), (3, F.lit("late.jpg")))])
    got = lookups.latest_listing(table(spark, sf, "documents").select(F.explode(names).alias("n")).select("n.*"))
    return got.filter(lookups.is_attachment(F.col("pmcid"), F.col("version"), F.col("name"))).select("pmcid", "version", "name", F.col("bytes").cast("int").alias("bytes"))


@query("csv_round_trip", f"WITH {PAPERS} SELECT uid, title, doi, abstract, '' AS more FROM papers WHERE k % 10 = 1".replace("WHERE k % 10 = 1", ""))
def _(spark, sf):
    where = scratch(spark, "csv")
    io.write_csv(papers(spark, sf).select("uid", "title", "doi", "abstract"), where)
    return io.read_csv(spark, where, ["uid", "title", "doi", "abstract", "more"])


@query("json_lines_round_trip", f"WITH {PAPERS} SELECT uid, abstract, [keywords, venue] AS sources FROM papers")
def _(spark, sf):
    where = scratch(spark, "jsonl")
    io.write_jsonl(papers(spark, sf).select("uid", "abstract", F.array("keywords", "venue").alias("sources")), where)
    return io.read_jsonl(spark, where, "uid string, abstract string, sources array<string>")


@query("text_folder_scan", f"WITH {PAPERS} SELECT title AS line, count(*) AS n FROM papers WHERE k % 2 = 0 GROUP BY 1")
def _(spark, sf):
    where = scratch(spark, "texts")
    p = papers(spark, sf)
    p.filter("k % 2 = 0").select(F.col("title").alias("value")).write.text(f"{where}/a/notes.md")
    p.filter("k % 2 = 1").select(F.col("title").alias("value")).write.text(f"{where}/node_modules")
    io.rename_parts(spark, f"{where}/a/notes.md", ".txt", ".md")
    return io.read_text_lines(spark, where, ["md"], skip=["node_modules"], line_sep="\n").groupBy("line").agg(F.count(F.lit(1)).alias("n"))


@query("uid_file", f"WITH {PAPERS} SELECT 'doi:' || doi AS uid FROM papers WHERE doi <> ''")
def _(spark, sf):
    where = scratch(spark, "uids") + "/list.csv"
    rows = papers(spark, sf).select("uid", F.when(F.col("doi") == "", "not-a-doi").otherwise(F.concat(F.lit("https://doi.org/"), "doi")).alias("doi"), F.lit("a, b").alias("title"))
    onefile.write_csv_file(rows.select("doi", "title"), where, ["doi"])
    return io.uid_list(spark, where)


@query("csv_one_file", f"""WITH {PAPERS}, q AS (SELECT uid, [CASE WHEN regexp_matches(title, '[",\r\n]') THEN '"' || replace(title, '"', '""') || '"' ELSE title END,
        CASE WHEN regexp_matches(abstract, '[",\r\n]') THEN '"' || replace(abstract, '"', '""') || '"' ELSE abstract END] AS f FROM papers),
    t AS (SELECT 'uid,title,abstract' || chr(13) || chr(10) || string_agg(uid || ',' || f[1] || ',' || f[2], chr(13) || chr(10) ORDER BY uid) || chr(13) || chr(10) AS t FROM q)
    SELECT line, count(*) AS n, max(strlen(t)) AS bytes FROM (SELECT unnest(string_split(t, chr(10))) AS line, t FROM t) WHERE line <> '' GROUP BY 1""")
def _(spark, sf):
    where = scratch(spark, "csv") + "/all.csv"
    onefile.write_csv_file(papers(spark, sf).select("uid", "title", "abstract"), where, ["uid"])
    lines = spark.read.option("lineSep", "\n").text(where).select(F.col("value").alias("line"), F.col("_metadata.file_size").alias("size"))
    return lines.filter("line <> ''").groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("bytes"))


@query("reference_file", f"""WITH {CITED}, r AS (SELECT row_number() OVER (ORDER BY date, uid) AS place, {SQL['VAN'].replace('n = ', 's_n = ').replace('n > ', 's_n > ').replace('n-1', 's_n-1')} AS text FROM (SELECT *, n AS s_n FROM s)),
    t AS (SELECT string_agg(place || '. ' || text, chr(10) ORDER BY place) || chr(10) AS t FROM r) SELECT line, count(*) AS n, max(strlen(t)) AS bytes FROM (SELECT unnest(string_split(t, chr(10))) AS line, t FROM t) WHERE line <> '' GROUP BY 1""")
def _(spark, sf):
    """Lines of the file of all orders, which carry their places, with the file's size."""
    where = scratch(spark, "refs")
    (path,) = R.write_references(cited(spark, sf), ["VAN"], f"{where}/list", ["date", "uid"])
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_size").alias("size"))
    return lines.groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("bytes"))


@query("manifest_seeds", "SELECT '10.1234/d' || doc_id AS doi, CASE WHEN lang = 'en' THEN 'methods_reference' ELSE 'methods_other' END AS role, '[' || lang || '] T | Q' || doc_id AS context FROM documents")
def _(spark, sf):
    k = F.col("doc_id").cast("string")
    d = table(spark, sf, "documents").select(F.concat(F.lit("doi:10.1234/D"), k).alias("doi"), F.col("lang").alias("topic"), F.lit("T").alias("title"), F.concat(F.lit("Q"), k).alias("question"))
    return Y.manifest_seeds(d, "repo", "repo/literature/manifest_methods.tsv", "methods_reference", "^en$").select("doi", "role", "context")


@query("rules_from_file", f"WITH {PAPERS} SELECT uid, CASE WHEN regexp_matches(title, '^the', 'i') THEN 'titled' ELSE 'rest' END AS category FROM papers")
def _(spark, sf):
    where = scratch(spark, "rules") + "/config.json"
    io.write_text(spark, where, '{"classify": {"category": [{"name": "titled", "title": "^the"}], "default_category": "rest"}, "search": {}}')
    r = Y.rules(Y.document(spark, where))
    return papers(spark, sf).select("uid", C.category(r["category"], F.lit(""), F.col("title"), F.col("abstract"), r["default"]).alias("category"))


@query("input_resolver", f"WITH {PAPERS} SELECT uid, title FROM papers")
def _(spark, sf):
    where = scratch(spark, "catalogue")
    io.write_csv(papers(spark, sf).select("uid", "title"), f"{where}/exports/mine.csv")
    return Y.input_table(spark, "mine.csv", where)


@query("refetch_states", "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN true WHEN 3 THEN o_orderkey % 4 < 2 WHEN 4 THEN false ELSE true END AS again FROM orders")
def _(spark, sf):
    k = F.col("o_orderkey")
    status = F.element_at(F.array(*[F.lit(s) for s in ("ok", "partial", "deferred", "none", "removed", "error")]), (k % 6 + 1).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", U.again(status, F.when(k % 4 < 2, "2024-01-01").otherwise("2024-05-20"), TODAY).alias("again"))


@query("checkpoint_pieces", "SELECT doc_id FROM documents")
def _(spark, sf):
    root = scratch(spark, "pieces") + uuid.uuid4().hex
    d = table(spark, sf, "documents").select("doc_id")
    done = lambda i: Z.piece(d.filter(F.col("doc_id") % 3 == i), root, f"p{i}")
    for i in (0, 1, 0, 2):  # a piece that is done isn't done again
        done(i)
    return Z.pieces(spark, root, d.schema)


@query("body_font", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 9.0 ELSE 11.0 END AS size FROM pages")
def _(spark, sf):
    k = F.col("page_id")
    spans = F.explode(F.array(*[F.struct(F.lit(s).alias("size"), F.when(k % 2 == even, F.lit(t)).otherwise("x").alias("text")) for s, even, t in ((9.0, 0, "long text é"), (11.0, 1, "long text e!"), (14.0, 2, "x"))]))
    return M.body_size(table(spark, sf, "pages").select("page_id", spans.alias("s")).select("page_id", "s.*"), "page_id")


@query("candidate_sites", f"""WITH {FOUND}, w AS (SELECT uid, 'site' || uid % 50 || '.org' AS domain, 'https://site' || uid % 50 || '.org/p' AS url FROM t)
    SELECT domain, count(*) AS n_papers, 1 AS n_urls, any_value(url) AS top_url, array_to_string(list_transform(list_sort(list(uid))[1:5], lambda x: CAST(x AS VARCHAR)), '; ') AS example_papers FROM w GROUP BY 1""")
def _(spark, sf):
    got = K.candidate_sites(K.classified(K.extract(said(spark, sf), "uid", "text")))
    ordered = F.array_join(F.transform(F.array_sort(F.transform(F.split("example_papers", "; "), lambda x: x.cast("long"))), lambda x: x.cast("string")), "; ")
    return got.select("domain", "n_papers", F.col("n_urls").cast("int").alias("n_urls"), "top_url", ordered.alias("example_papers"))


@query("catalogue_links", f"WITH {FOUND} SELECT uid, 'o' || uid || '/r' || uid AS repo, 'github' AS kind FROM t WHERE uid % 3 = 0 UNION ALL SELECT uid, '', 'gitlab' FROM t WHERE uid % 3 = 0")
def _(spark, sf):
    all_links = K.classified(K.extract(said(spark, sf), "uid", "text"))
    repos, others = K.by_source(all_links, table(spark, sf, "documents").filter("doc_id % 3 = 0").select(F.col("doc_id").alias("uid")))
    return repos.select("uid", "repo", "kind").unionByName(others.select("uid", F.lit("").alias("repo"), "kind"))


@query("site_first_archived", "SELECT url, CASE WHEN page_id % 2 = 0 THEN '2004-05-06' ELSE '' END AS first_archived FROM pages")
def _(spark, sf):
    body = F.when(F.col("page_id") % 2 == 0, '[["timestamp"],["20040506070809"]]').when(F.col("page_id") % 3 == 0, "[]").otherwise("no json")
    return lookups.first_archived(table(spark, sf, "pages").select("url", body.alias("value")))


@query("files_settled", "SELECT 'ord:' || o_orderkey AS uid, CASE WHEN o_orderkey % 2 = 0 THEN 'removed' ELSE 'ok' END AS status, CASE WHEN o_orderkey % 2 = 0 THEN 'False' ELSE 'True' END AS has_pdf, '1/2' AS attachments FROM orders")
def _(spark, sf):
    uid = F.concat(F.lit("ord:"), F.col("o_orderkey").cast("string")).alias("uid")
    o = table(spark, sf, "orders")
    index = o.select(uid, F.lit("ok").alias("status"), F.lit("").alias("reason"), F.lit("True").alias("has_pdf"), F.lit("2/2").alias("attachments"))
    done = o.filter("o_orderkey % 2 = 0").select(uid, F.lit("paper").alias("kind"), F.lit("paper.pdf").alias("file"), F.lit("").alias("target"))
    atts = o.select(uid, F.explode(F.array(F.struct(F.lit("a.jpg").alias("file"), F.lit("ok").alias("status")), F.struct(F.lit("b").alias("file"), F.lit("moved").alias("status")))).alias("f")).select("uid", "f.*")
    return L.settled_index(index, atts, done, "delete").select("uid", "status", "has_pdf", "attachments")
