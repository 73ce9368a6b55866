"""Queries of resolution inside a batch and of many names in texts over the given tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylark.operators import catalogue as C
from quarrylark.operators import matching as M
from quarrylark.operators import resolution as R
from quarrylark.plans.registry import query, table

#: Documents as found records: copies share their text's digest, neighbours two running keys, so that works are chains.
RECORDS = """r AS (SELECT doc_id, 'd' || doc_id AS uid, source, [md5(coalesce(text, '')), CASE WHEN doc_id % 7 <> 0 THEN 'a' || doc_id // 3 END, CASE WHEN doc_id % 5 <> 0 THEN 'b' || (doc_id + 1) // 3 END] AS keys,
        row_number() OVER (ORDER BY source, doc_id) AS n FROM documents),
    k AS (SELECT n, key, rank FROM (SELECT n, unnest(keys) AS key, unnest([1, 2, 3]) AS rank FROM r) WHERE key IS NOT NULL)"""
#: What is stored: some of the keys lead to works of nations.
ALIASES = "s AS (SELECT 'a' || n_nationkey * 4 AS key, 'n:' || n_name AS target FROM nation)"
LINKED = f"""WITH RECURSIVE {RECORDS}, {ALIASES}, e AS (SELECT DISTINCT a.n AS a, b.n AS b FROM k a JOIN k b USING (key)),
    reach(a, b) AS (SELECT n, n FROM r UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b),
    c AS (SELECT a AS n, min(b) AS first FROM reach GROUP BY 1),
    h AS (SELECT first, arg_min(target, k.n * 10 + rank) AS target FROM k JOIN s USING (key) JOIN c ON c.n = k.n GROUP BY 1),
    m AS (SELECT r.doc_id, coalesce(h.target, f.uid) AS resolved, r.source, r.n FROM r JOIN c USING (n) JOIN r f ON f.n = c.first LEFT JOIN h ON h.first = c.first)"""


def found(spark, sf):
    i = F.col("doc_id")
    part = lambda name, value, keep: F.when(keep, F.concat(F.lit(name), F.floor(value / 3).cast("string")))
    keys = F.array(F.md5(F.coalesce("text", F.lit(""))), part("a", i, i % 7 != 0), part("b", i + 1, i % 5 != 0))
    return table(spark, sf, "documents").select("doc_id", F.concat(F.lit("d"), i.cast("string")).alias("uid"), "source", "lang", "n_chars", keys.alias("keys"))


def stored(spark, sf):
    return table(spark, sf, "nation").select(F.concat(F.lit("a"), (F.col("n_nationkey") * 4).cast("string")).alias("alias"), F.concat(F.lit("n:"), "n_name").alias("target"))


@query("alias_linked", f"{LINKED} SELECT doc_id, resolved FROM m")
def _(spark, sf):
    return R.resolve_linked(found(spark, sf), ["source", "doc_id"], stored(spark, sf)).select("doc_id", "resolved")


@query("alias_in_order", f"""WITH RECURSIVE {RECORDS}, {ALIASES}, f AS (SELECT key, min(n) AS first FROM k GROUP BY 1),
    l AS (SELECT k.n, min(rank) AS rank FROM k JOIN f USING (key) LEFT JOIN s USING (key) WHERE target IS NOT NULL OR first < k.n GROUP BY 1),
    t AS (SELECT l.n, target, CASE WHEN target IS NULL THEN first END AS up FROM l JOIN k USING (n, rank) JOIN f USING (key) LEFT JOIN s USING (key)),
    climb(n, place) AS (SELECT n, n FROM r UNION ALL SELECT climb.n, t.up FROM climb JOIN t ON t.n = climb.place WHERE t.up IS NOT NULL),
    top AS (SELECT n, min(place) AS place FROM climb GROUP BY 1)
    SELECT r.doc_id, coalesce(t.target, o.uid) AS resolved FROM top JOIN r USING (n) JOIN r o ON o.n = top.place LEFT JOIN t ON t.n = top.place""")
def _(spark, sf):
    return R.resolve_in_order(found(spark, sf), ["source", "doc_id"], stored(spark, sf)).select("doc_id", "resolved")


@query("batch_merge", f"""{LINKED}, v AS (SELECT m.*, d.lang, d.n_chars FROM m JOIN documents d USING (doc_id))
    SELECT resolved AS uid, array_to_string(list_sort(list(DISTINCT source)), ';') AS sources, max(n_chars) AS cited_by, arg_max(lang, n) AS newest, arg_min(lang, n) AS oldest FROM v GROUP BY 1""")
def _(spark, sf):
    r = R.resolve_linked(found(spark, sf), ["source", "doc_id"], stored(spark, sf))
    seq = F.struct("source", "doc_id")
    rows = r.select("resolved", F.array("source").alias("sources"), F.col("n_chars").alias("cited_by"), F.col("lang").alias("newest"), F.col("lang").alias("oldest"), seq.alias("seq"))
    m = C.merge_fields(rows, "resolved", "seq", ["sources"], ["cited_by"], ["newest"], ["oldest"])
    return m.select(F.col("resolved").alias("uid"), F.array_join("sources", ";").alias("sources"), "cited_by", "newest", "oldest")


# ---------------------------------------------------------------- many names in one pass

#: Words of the benchmark's items are the names; those of an even length are found in any case.
W = r"\p{L}\p{M}\p{Nd}\p{Pc}-"
NAMES = rf"names AS (SELECT DISTINCT w AS name, length(w) % 2 = 0 AS loose FROM (SELECT unnest(regexp_extract_all(text, '[{W}]+')) AS w FROM benchmark))"
HITS = rf"""pieces AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[{W}]+|[^{W}]+')) AS p, generate_subscripts(regexp_extract_all(coalesce(text, ''), '[{W}]+|[^{W}]+'), 1) AS i FROM documents),
    placed AS (SELECT doc_id, p, sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i) - length(p) AS place FROM pieces),
    hits AS (SELECT doc_id, name, place FROM placed JOIN names ON name = p WHERE NOT loose UNION ALL SELECT doc_id, name, place FROM placed JOIN names ON lower(name) = lower(p) WHERE loose)"""


def names(spark, sf):
    words = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(f"[{W}]+"), F.lit(0))).alias("name"))
    # names are words here, so nothing in them is syntax
    return M.vocabulary_of(words.select("name", F.concat(F.when(F.length("name") % 2 == 0, "(?i)").otherwise(""), "name").alias("pattern")))


@query("name_mentions", f"WITH {NAMES}, {HITS} SELECT doc_id, name, CAST(min(place) AS INTEGER) AS place, CAST(count(*) AS INTEGER) AS n FROM hits GROUP BY 1, 2")
def _(spark, sf):
    return M.mentions(table(spark, sf, "documents"), "doc_id", "text", names(spark, sf))


@query("name_counts", f"WITH {NAMES}, {HITS} SELECT name, count(DISTINCT doc_id) AS texts, count(*) AS n FROM hits GROUP BY 1")
def _(spark, sf):
    return M.mention_counts(table(spark, sf, "documents"), "doc_id", "text", names(spark, sf))


@query("first_appearance", rf"""WITH {NAMES}, {HITS}, t AS (SELECT doc_id, CASE WHEN doc_id % 5 > 0 THEN CAST(2000 + doc_id * 7 % 25 AS VARCHAR) ELSE '' END AS date, length(string_split(coalesce(text, ''), chr(10))[1]) AS title_end FROM documents),
    first AS (SELECT name, min((CASE date WHEN '' THEN '9999' ELSE date END, doc_id, date)) AS f FROM hits JOIN t USING (doc_id) WHERE place < title_end GROUP BY 1),
    e AS (SELECT doc_id, string_agg(name, '; ') AS entities FROM (SELECT DISTINCT doc_id, name FROM hits) GROUP BY 1),
    held AS (SELECT a.name, b.name AS part FROM names a JOIN names b ON contains(a.name, b.name)),
    n AS (SELECT part AS name, count(DISTINCT doc_id) AS papers FROM (SELECT DISTINCT doc_id, name FROM hits) x JOIN held USING (name) GROUP BY 1)
    SELECT name, f[3] AS date, f[2] AS uid, coalesce(papers, 0) AS papers FROM first LEFT JOIN n USING (name)""")
def _(spark, sf):
    v, i = names(spark, sf), F.col("doc_id")
    date = F.when(i % 5 > 0, (2000 + i * 7 % 25).cast("string")).otherwise("")
    title = F.split(F.coalesce("text", F.lit("")), "\n")[0]
    papers = table(spark, sf, "documents").select(i.alias("uid"), date.alias("date"), title.alias("title"), F.array_join(M.labels(F.col("text"), v), "; ").alias("entities"))
    return M.first_appearance(papers, v)
