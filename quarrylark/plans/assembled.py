"""Queries of the assembly, inclusion, file and overview operators."""

from __future__ import annotations

from pyspark.sql import functions as F


from quarrylark.operators import assembly as A
from quarrylark.operators import files as L
from quarrylark.operators import inclusion as I
from quarrylark.operators import mining as M
from quarrylark.operators import overview as O
from quarrylark.plans.registry import TODAY, WORKS, query, table, works
from quarrylark.sources import records as N


@query("hit_groups", """SELECT user_id AS uid, list_sort(list(DISTINCT event_type)) AS groups, list_sort(list(DISTINCT CASE WHEN value > 50 THEN 'focused' ELSE 'broad' END)) AS scopes, ['events'] AS sources FROM events GROUP BY 1""")
def _(spark, sf):
    e = table(spark, sf, "events")
    return A.hit_groups(e.select(F.col("user_id").alias("uid"), F.col("event_type").alias("group"), F.when(F.col("value") > 50, "focused").otherwise("broad").alias("scope"), F.lit("events").alias("source")))


@query("seed_rollup", """WITH s AS (SELECT CAST(l_orderkey AS VARCHAR) AS doi, 'repo' || l_returnflag AS source_repo, l_linestatus AS role, CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE 'id' || l_linenumber END AS rid FROM lineitem),
    r AS (SELECT doi, source_repo, string_agg(DISTINCT rid, ', ' ORDER BY rid) FILTER (rid <> '') AS ids FROM s GROUP BY 1, 2),
    i AS (SELECT doi, coalesce(string_agg(source_repo || ' registry: ' || ids, '; ' ORDER BY source_repo), '') AS registry_ids FROM r GROUP BY 1)
    SELECT doi, list_sort(list(DISTINCT role)) AS roles, string_agg(DISTINCT source_repo || ':' || role, '; ' ORDER BY source_repo || ':' || role) AS refs, any_value(registry_ids) AS registry_ids FROM s JOIN i USING (doi) GROUP BY 1""")
def _(spark, sf):
    n = F.col("l_linenumber")
    return A.seed_rollup(table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("doi"), F.concat(F.lit("repo"), "l_returnflag").alias("source_repo"), F.col("l_linestatus").alias("role"), F.when(n % 3 == 0, "").otherwise(F.concat(F.lit("id"), n.cast("string"))).alias("registry_id")))


@query("link_list", """WITH h0 AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS root, regexp_extract_all(html, 'href="([^"]+)"', 1) AS hs FROM pages),
    h1 AS (SELECT page_id, root, unnest(hs) AS href, generate_subscripts(hs, 1) AS s FROM h0), u AS (SELECT page_id, CASE WHEN href[1] = '/' THEN root || href ELSE href END AS url, min(s) AS s FROM h1 GROUP BY 1, 2)
    SELECT page_id AS uid, string_agg(url, '; ' ORDER BY s) AS code_links FROM u GROUP BY 1""")
def _(spark, sf):
    return A.link_list(M.hrefs(table(spark, sf, "pages")).withColumnRenamed("page_id", "uid"))


@query("related_versions", """WITH p AS (SELECT 's' || s_suppkey AS a, 'n' || s_nationkey AS b, s_suppkey AS q FROM supplier), u AS (SELECT a AS doi, 'published as ' || b AS related, q FROM p UNION ALL SELECT b, 'preprint ' || a, q FROM p)
    SELECT doi, arg_max(related, q) AS related FROM u GROUP BY 1""")
def _(spark, sf):
    s = table(spark, sf, "supplier")
    return A.related_versions(s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("preprint_doi"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("published_doi"), F.col("s_suppkey").alias("seq")), "seq")


@query("resolve_cascade", """SELECT doc_id AS doi, CASE WHEN l.doc_id IS NOT NULL THEN 'label' WHEN b.item_id IS NOT NULL THEN 'benchmark' WHEN p.page_id IS NOT NULL THEN 'page' ELSE '' END AS resolved_via,
    CASE WHEN l.doc_id IS NOT NULL THEN 'l' || d.doc_id WHEN b.item_id IS NOT NULL THEN 'b' || d.doc_id WHEN p.page_id IS NOT NULL THEN 'p' || d.doc_id ELSE '' END AS uid
    FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN benchmark b ON item_id = d.doc_id LEFT JOIN pages p ON page_id = d.doc_id""")
def _(spark, sf):
    named = lambda t, k, p: table(spark, sf, t).select(F.col(k).alias("doi"), F.concat(F.lit(p), F.col(k).cast("string")).alias("uid"))
    return A.resolve_cascade(table(spark, sf, "documents").select(F.col("doc_id").alias("doi")), [("label", named("labels", "doc_id", "l")), ("benchmark", named("benchmark", "item_id", "b")), ("page", named("pages", "page_id", "p"))])


RULES = {
    "category": [{"name": "review", "text": r"\bthat\b"}, {"name": "software/resource", "title": r"[|]"}], "default": "application/association", "modality": {"und": r"\bund\b", "les": r"\bles\b"},
    "species": {"human": r"\bque\b", "mouse": r"\bder\b"}, "entities": {"The": "The", "le": "(?i)le"}, "core_title": r"\bthe\b", "landmark_roles": ["toxic"],
}


def _rows(spark, sf):
    w = works(spark, sf)
    blank = ["pub_date", "pub_year", "pub_types", "source_db", "keywords", "mesh", "pmid", "url", "license", "related_doi"]
    records = w.select("uid", "title", F.col("text").alias("abstract"), F.col("uid").alias("doi"), F.col("source").alias("journal"), F.lit("A B, C D, E F, G H").alias("authors"), F.lit(False).alias("is_preprint"), F.lit(False).alias("is_open_access"), F.col("n_chars").alias("cited_by"), *[F.lit("").alias(b) for b in blank])
    hits = w.filter("n_chars > 300").select("uid", F.col("lang").alias("group"), F.when(F.col("n_chars") > 1500, "focused").otherwise("broad").alias("scope"), F.col("source").alias("source"))
    labels = table(spark, sf, "labels")
    seeds = labels.select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("doi"), F.lit("notes").alias("source_repo"), F.when(F.col("toxic") == 1, "toxic").otherwise("cited").alias("role"), F.lit("").alias("registry_id"))
    return A.catalogue_rows(records, hits, seeds, RULES, "2011-01-01", TODAY)


WORD = r"(^|[^\p{L}\p{N}_])%s([^\p{L}\p{N}_]|$)"


@query("catalogue_rows", f"""WITH {WORKS}, c AS (SELECT w.*, l.doc_id IS NOT NULL AS seed, l.toxic = 1 AS landmark,
    CASE WHEN regexp_matches(title || ' ' || coalesce(text, ''), '{WORD % 'that'}', 'i') THEN 'review' WHEN contains(title, '|') THEN 'software/resource' ELSE 'application/association' END AS category,
    regexp_matches(title, '{WORD % 'the'}', 'i') AS core_title, n_chars > 1500 AS focused, n_chars > 300 AND n_chars <= 1500 AS broad FROM works w LEFT JOIN labels l USING (doc_id)),
    t AS (SELECT *, CASE WHEN landmark THEN 'landmark' WHEN focused AND (core_title OR category <> 'application/association') THEN 'core' WHEN focused THEN 'related' WHEN seed AND core_title THEN 'related' ELSE '' END AS tier FROM c)
    SELECT uid, category, CASE WHEN category = 'review' THEN 'review' ELSE 'article' END AS resource_type, tier, CASE WHEN tier <> '' THEN 'catalogue' WHEN seed THEN 'off_topic_seed' WHEN broad THEN 'broad' ELSE 'dropped' END AS route,
    CASE WHEN n_chars > 300 THEN lang ELSE '' END AS matched_groups, CASE WHEN seed THEN 'notes:' || CASE WHEN landmark THEN 'toxic' ELSE 'cited' END ELSE '' END AS local_refs, n_chars AS cited_by, 'A B, C D, E F et al.' AS authors FROM t""")
def _(spark, sf):
    return _rows(spark, sf).select("uid", "category", "resource_type", "tier", "route", "matched_groups", "local_refs", F.col("cited_by").cast("long").alias("cited_by"), "authors")


@query("repository_inclusion", """WITH p AS (SELECT p_partkey, p_size, p_partkey % 97 = 0 AS gone, p_partkey % 31 = 0 AS fork, p_partkey % 2 = 0 AS papers, p_size > 30 AS relevant, p_partkey % 3 = 0 AS own, p_partkey % 5 = 0 AS core, p_partkey % 11 = 0 AS loc, p_partkey % 22 = 0 AS reg,
    CASE WHEN contains(p_type, 'STEEL') THEN 'pypi' ELSE 'github' END AS kind FROM part)
    SELECT p_partkey, CASE WHEN gone THEN 'repository gone' WHEN fork THEN 'fork' WHEN papers AND (relevant OR (own AND core)) THEN 'linked from catalogued paper' WHEN loc AND (relevant OR reg) THEN 'linked from local project' WHEN kind = 'pypi' THEN 'package index match'
    WHEN relevant THEN 'relevant search hit, >= 3 stars' ELSE 'search hit below inclusion bar' END AS reason, CASE WHEN core OR loc OR p_size >= 20 OR kind = 'pypi' THEN 'core' ELSE 'related' END AS tier, 'stars=' || p_size AS details FROM p""")
def _(spark, sf):
    k, size, none = F.col("p_partkey"), F.col("p_size"), F.lit("")
    kind = F.when(F.col("p_type").contains("STEEL"), "pypi").otherwise("github")
    r = I.repository_reason(gone=k % 97 == 0, fork=k % 31 == 0, papers=k % 2 == 0, relevant=size > 30, own_code=k % 3 == 0, core_papers=k % 5 == 0, stars=size, local=k % 11 == 0, registry=k % 22 == 0, kind=kind)
    return table(spark, sf, "part").select("p_partkey", r["reason"].alias("reason"), I.repository_tier(k % 5 == 0, k % 11 == 0, size, kind).alias("tier"), I.details(size, none, none, F.lit(False)).alias("details"))


@query("site_inclusion", """WITH p AS (SELECT page_id, url, CASE page_id % 4 WHEN 0 THEN 200 WHEN 1 THEN 403 WHEN 2 THEN 404 ELSE 500 END AS st, page_id % 3 = 0 AS cur, page_id % 5 = 0 AS rel, CASE WHEN page_id % 7 = 0 THEN '' ELSE '2015-03-01' END AS arch FROM pages)
    SELECT page_id, coalesce((st = 200 AND (cur OR rel)) OR (cur AND st = 403) OR (cur AND st <> 200 AND arch <> ''), false) AS included, CASE WHEN st <> 200 AND st <> 403 AND cur AND arch <> '' THEN 'https://web.archive.org/web/20150301/' || url ELSE url END AS link FROM p""")
def _(spark, sf):
    k = F.col("page_id")
    s = I.site_inclusion(k % 3 == 0, F.when(k % 4 == 0, 200).when(k % 4 == 1, 403).when(k % 4 == 2, 404).otherwise(500), k % 5 == 0, F.when(k % 7 == 0, "").otherwise("2015-03-01"), F.col("url"))
    return table(spark, sf, "pages").select("page_id", s["included"].alias("included"), s["link"].alias("link"))


@query("file_plan", """WITH f AS (SELECT o_orderkey, CASE WHEN l_linestatus = 'F' THEN 'figure' ELSE 'supplementary' END AS kind, 'f' || l_linenumber || '.' || lower(l_returnflag) AS file FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'
    UNION ALL SELECT o_orderkey, 'paper', 'paper.pdf' FROM orders WHERE o_orderstatus = 'F')
    SELECT DISTINCT 'ord:' || o_orderkey AS uid, kind, file, '/out/' || o_orderkey || CASE kind WHEN 'paper' THEN '/' ELSE '/attachments/' END || file AS target FROM f WHERE kind IN ('paper', 'figure')""")
def _(spark, sf):
    uid = lambda c: F.concat(F.lit("ord:"), F.col(c).cast("string")).alias("uid")
    rows = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(uid("o_orderkey"), F.lit("").alias("title"))
    papers = table(spark, sf, "orders").select(uid("o_orderkey"), F.lit("paper.pdf").alias("file"), F.lit("pdf").alias("ext"), F.lit("").alias("bytes"), F.lit("").alias("path"))
    name = F.concat(F.lit("f"), F.col("l_linenumber").cast("string"), F.lit("."), F.lower("l_returnflag"))
    atts = table(spark, sf, "lineitem").select(uid("l_orderkey"), F.when(F.col("l_linestatus") == "F", "figure").otherwise("supplementary").alias("kind"), name.alias("file"), F.lower("l_returnflag").alias("ext"), F.lit("ok").alias("status"), *[F.lit("").alias(c) for c in ("bytes", "path", "label", "caption", "url")])
    return L.plan(L.pick(L.listing(rows, papers, atts), kind="paper,figure"), "copy", "/out").select("uid", "kind", "file", "target")


@query("overview_rows", r"""SELECT 'doc:' || doc_id AS uid, substr(t, 1, 2000) AS summary, CASE WHEN t = '' THEN '' WHEN b.text IS NOT NULL THEN 'abstract' ELSE 'fulltext' END AS summary_from, '' AS keywords, 'unpaywall' AS fulltext_sources,
    CASE WHEN l.doc_id IS NULL THEN 'full text' WHEN quality = 1 THEN 'full text (retry)' ELSE '' END AS pending FROM (SELECT doc_id, trim(regexp_replace(coalesce(b.text, substr(d.text, 1, 20000), ''), '[ \t\n\r\f\v]+', ' ', 'g')) AS t FROM documents d LEFT JOIN benchmark b ON item_id = doc_id)
    LEFT JOIN benchmark b ON item_id = doc_id LEFT JOIN labels l USING (doc_id)""".replace("coalesce(b.text, substr(d.text, 1, 20000), '')", "coalesce(b.text, CASE WHEN l.doc_id IS NOT NULL THEN substr(d.text, 1, 20000) END, '')").replace("LEFT JOIN benchmark b ON item_id = doc_id)\n", "LEFT JOIN benchmark b ON item_id = doc_id LEFT JOIN labels l USING (doc_id))\n"))
def _(spark, sf):
    uid = lambda c: F.concat(F.lit("doc:"), F.col(c).cast("string")).alias("uid")
    none = lambda *names: [F.lit("").alias(n) for n in names]
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    records = table(spark, sf, "benchmark").select(uid("item_id"), F.col("text").alias("abstract"), F.array().cast("array<string>").alias("epmc_ids"), *none("keywords", "mesh", "pmcid", "oa_pdf_url"))
    index = labels.join(docs.select("doc_id", "text"), "doc_id", "left").select(uid("doc_id"), F.when(F.col("quality") == 1, "error").otherwise("ok").alias("status"), "text", *none("checked_on", "attachments"))
    atts = labels.filter("quality > 1").select(uid("doc_id"), *none("status", "reason"))
    rows = docs.select(uid("doc_id"), F.lit("article").alias("resource_type"), F.concat(F.lit("10.9/"), F.col("doc_id").cast("string")).alias("doi"))
    out = O.rows(rows, records, index, atts, rows.select("uid", F.lit("").alias("description")), TODAY)
    return out.drop("resource_type", "doi")


@query("records_normalise", r"""SELECT 'epmc:' || doc_id AS uid, source AS journal, trim(regexp_replace(regexp_replace(coalesce(text, ''), '<[^>]*>', ' ', 'g'), '[ \t\n\r\f\v]+', ' ', 'g')) AS abstract, coalesce(n_chars, 0) AS cited_by, lang = 'en' AS is_open_access FROM documents""")
def _(spark, sf):
    d = table(spark, sf, "documents")
    answer = F.struct(F.col("doc_id").cast("string").alias("id"), F.lit("MED").alias("source"), F.struct(F.struct(F.col("source").alias("title")).alias("journal")).alias("journalInfo"), F.col("text").alias("abstractText"), F.col("n_chars").alias("citedByCount"), F.when(F.col("lang") == "en", "Y").otherwise("N").alias("isOpenAccess"))
    return N.europe_pmc(d.select(F.to_json(answer).alias("value"))).select("uid", "journal", "abstract", F.col("cited_by").cast("long").alias("cited_by"), "is_open_access")
