"""Queries whose costly part comes late: texts and summaries of what cheaper conditions left; and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylark.operators import catalogue as C
from quarrylark.operators import overview as O
from quarrylark.operators import postings as P
from quarrylark.operators import texts as X
from quarrylark.plans.coverage import PAPERS, papers
from quarrylark.plans.registry import TODAY, query, table
from quarrylark.sources import onefile
from quarrylark.storage import shared_folder

UID = "'doc:' || doc_id"


def uid(c):
    return F.concat(F.lit("doc:"), F.col(c).cast("string")).alias("uid")


@query("filter_fulltext_late", f"""WITH {PAPERS}, m AS (SELECT uid, coalesce(text, '') AS t, regexp_extract(coalesce(text, ''), '(?i)[a-z]+(ing|tion|heit)[.]') AS hit FROM papers JOIN documents ON uid = {UID}
        WHERE tier = 'core' AND resource_type IN ('article', 'preprint') AND fulltext_md <> '' AND regexp_matches(coalesce(text, ''), '[a-z]+(ing|tion|heit)[.]', 'i'))
    SELECT uid, trim(regexp_replace(substr(t, CAST(greatest(instr(t, hit) - 80, 1) AS BIGINT), CAST(instr(t, hit) + length(hit) + 80 - greatest(instr(t, hit) - 80, 1) AS BIGINT)), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS context FROM m""")
def _(spark, sf):
    where = shared_folder(spark, "fulltexts")
    X.write_texts(table(spark, sf, "documents").select(uid("doc_id"), F.coalesce("text", F.lit("")).alias("fulltext")), where, buckets=8)
    return C.select(papers(spark, sf), tier="core", kind="article,preprint", fulltext="[a-z]+(ing|tion|heit)[.]", texts=where).select("uid", "context")


@query("filter_summary_lazy", rf"""WITH {PAPERS}, s AS (SELECT {UID} AS uid, trim(regexp_replace(coalesce(b.text, CASE WHEN l.doc_id IS NOT NULL THEN substr(d.text, 1, 20000) END, ''), '[ \t\n\r\f\v]+', ' ', 'g')) AS t
        FROM documents d LEFT JOIN benchmark b ON item_id = doc_id LEFT JOIN labels l USING (doc_id))
    SELECT uid, substr(t, 1, 2000) AS summary FROM papers JOIN s USING (uid) WHERE tier = 'landmark' AND regexp_matches(substr(t, 1, 2000) || ' ', '(ment|ung|tion) .*[.,] ', 'i')""")
def _(spark, sf):
    none = lambda *names: [F.lit("").alias(n) for n in names]
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    records = table(spark, sf, "benchmark").select(uid("item_id"), F.col("text").alias("abstract"), F.array().cast("array<string>").alias("epmc_ids"), *none("keywords", "mesh", "pmcid", "oa_pdf_url"))
    index = labels.join(docs.select("doc_id", "text"), "doc_id", "left").select(uid("doc_id"), F.lit("ok").alias("status"), "text", *none("checked_on", "attachments"))
    files = labels.limit(0).select(uid("doc_id"), *none("status", "reason"))
    summarise = lambda kept: O.rows(kept, records, index, files, kept.select("uid", F.lit("").alias("description")), TODAY)
    bare = papers(spark, sf).drop("summary", "keywords", "summary_from", "pending")
    return C.select(bare, tier="landmark", summary="(ment|ung|tion) .*[.,] ", summarise=summarise).select("uid", "summary")


@query("limit_without_last", f"WITH {PAPERS} SELECT uid FROM papers QUALIFY row_number() OVER (ORDER BY CAST(cited_by AS INTEGER) DESC, uid) <= (SELECT count(*) FROM papers) - 25")
def _(spark, sf):
    return C.select(papers(spark, sf), sort="cited_by", limit=-25).select("uid")


@query("search_indexed", "SELECT doc_id FROM documents WHERE contains(lower(text), 'ung') AND contains(lower(text), 'die') AND contains(lower(text), 'ver,')")
def _(spark, sf):
    """Three words, as parts, over the whole texts by way of the index."""
    where = shared_folder(spark, "index")
    P.build(table(spark, sf, "documents"), where, "doc_id", ["text"], buckets=16)
    return P.search(spark, where, "die VER, ung", "doc_id")


CHOSEN = "tier = 'core' AND resource_type = 'review' AND fulltext_status = 'partial' AND CAST(year AS INTEGER) BETWEEN 2012 AND 2021 AND regexp_matches(attachments, '^\\d+/[1-9]')"


@query("report_selectors", f"WITH {PAPERS} SELECT uid FROM papers WHERE {CHOSEN} UNION ALL SELECT uid FROM papers WHERE fulltext_status = '' AND added_on = '2024-05-15'")
def _(spark, sf):
    p = papers(spark, sf)
    one = O.chosen(p, kind="review", tier="core", fulltext="partial", year_from=2012, year_to=2021, attachments=True)
    return one.select("uid").unionByName(O.chosen(p, fulltext="not tried", new_on="2024-05-15").select("uid"))


@query("report_words_indexed", f"""WITH {PAPERS}, j AS (SELECT k, tier, lower(concat_ws(' ', title, authors, venue, doi, summary, keywords, uid, entities)) AS s FROM papers)
    SELECT k FROM j WHERE tier = 'related' AND contains(s, 'src') AND contains(s, 'zed') AND contains(s, 'the')""")
def _(spark, sf):
    """The same words by the index of the report's columns."""
    where, p = shared_folder(spark, "report"), papers(spark, sf)
    P.build(p, where, "k", [x for x in O.SEARCHED if x in p.columns], buckets=16)
    return O.chosen(p, "SRC zed the", tier="related", index=where, key="k").select("k")


@query("report_csv", f"""WITH {PAPERS}, q AS (SELECT date, uid, CASE WHEN regexp_matches(title, '[",\\n\\r]') THEN '"' || replace(title, '"', '""') || '"' ELSE title END AS title FROM papers WHERE tier = 'core'),
    t AS (SELECT 'uid,title' || chr(13) || chr(10) || string_agg(uid || ',' || title, chr(13) || chr(10) ORDER BY date DESC, uid) || chr(13) || chr(10) AS t FROM q)
    SELECT line, count(*) AS n, max(strlen(t)) AS bytes FROM (SELECT unnest(string_split(t, chr(13) || chr(10))) AS line, t FROM t) WHERE line <> '' GROUP BY 1""")
def _(spark, sf):
    """The chosen rows as one CSV file, in the report's order."""
    where = shared_folder(spark, "report") + "/rows.csv"
    rows = O.chosen(papers(spark, sf), tier="core")
    onefile.write_file(rows, where, [F.desc("date"), F.col("uid")], onefile.csv_line(["uid", "title"]), "\r\n", "uid,title\r\n", "\r\n", "uid,title\r\n")
    lines = spark.read.option("lineSep", "\r\n").text(where).select(F.col("value").alias("line"), F.col("_metadata.file_size").alias("size"))
    return lines.filter("line <> ''").groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("bytes"))


@query("findings", f"""WITH {PAPERS}, p AS (SELECT * FROM papers WHERE resource_type IN ('article', 'review', 'preprint', 'report', 'thesis', 'conference paper', 'book chapter')),
    l AS (SELECT p.*, trim(x) AS layer FROM p, unnest(string_split(modality, ';')) u(x) WHERE trim(x) <> '')
    SELECT 'Growth' AS "table", concat_ws(' | ', year, count(*) FILTER (resource_type = 'article'), count(*) FILTER (resource_type = 'review'), count(*) FILTER (resource_type = 'preprint'), count(*) FILTER (tier = 'landmark'), count(*) FILTER (tier = 'core'), count(*) FILTER (tier = 'related'), count(*)) AS cells FROM p GROUP BY year
    UNION ALL SELECT * FROM (SELECT 'Most cited', concat_ws(' | ', date, title, cited_by) FROM p ORDER BY CAST(cited_by AS INTEGER) DESC, uid LIMIT 30)
    UNION ALL SELECT 'Most cited of each layer', concat_ws(' | ', layer, place, title, cited_by) FROM (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY CAST(cited_by AS INTEGER) DESC, uid) AS place FROM l) WHERE place <= 5
    UNION ALL SELECT 'Layers over time', concat_ws(' | ', year, layer, count(*)) FROM l WHERE tier IN ('landmark', 'core') GROUP BY year, layer
    UNION ALL SELECT * FROM (SELECT 'Newest', concat_ws(' | ', date, title) FROM p ORDER BY date DESC, uid LIMIT 10)
    UNION ALL SELECT 'Coverage', concat_ws(' | ', tier, count(*), count(*) FILTER (fulltext_status = 'ok'), count(*) FILTER (fulltext_status = 'partial'), count(*) FILTER (fulltext_status = 'deferred'), count(*) FILTER (fulltext_status = 'none')) FROM p GROUP BY tier""")
def _(spark, sf):
    return O.finding_rows(papers(spark, sf))
