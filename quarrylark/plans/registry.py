"""Registered queries over the driver's tables and their SQL twins, and how the tables stand for catalogue entities.

documents are works (uid `doc:<id>`, title is the first line), orders are dated works with citation counts, events are
search hits, labels are seeds, pages are websites, lineitem rows are attachments of their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylark.functions import scalars as S
from quarrylark.functions import terms as T
from quarrylark.operators import articles as X
from quarrylark.operators import catalogue as C
from quarrylark.operators import mining as M

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

CATEGORIES = {"table": r"[|]", "shouting": r"!!", "noise": r"[$%#&*]{3}"}
TAGS = {"that": r"\bthat\b", "der": r"\bder\b", "les": r"\bles\b", "que": r"\bque\b"}
TAGS = {n: rf"(?:^|[^a-z]){n}(?:[^a-z]|$)" for n in TAGS}
TODAY = "2024-06-01"


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def works(spark, sf) -> DataFrame:
    """documents as catalogue rows."""
    d = table(spark, sf, "documents")
    t = S.text(F.col("text"))
    return d.select("doc_id", F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("uid"), S.collapse(F.split(t, "\n")[0]).alias("title"), "text", "lang", "source", "n_chars")


WORKS = r"""works AS (SELECT doc_id, 'doc:' || doc_id AS uid, text, lang, source, n_chars,
    trim(regexp_replace(split_part(coalesce(text, ''), chr(10), 1), '[ \t\n\r\f\v]+', ' ', 'g')) AS title FROM documents)"""


def dated(spark, sf) -> DataFrame:
    """orders as dated works."""
    o = table(spark, sf, "orders")
    return o.select(F.concat(F.lit("ord:"), F.col("o_orderkey").cast("string")).alias("uid"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.lower(F.substring("o_orderpriority", 3, 20)).alias("tier"), F.col("o_orderstatus").alias("category"), F.floor("o_totalprice").cast("long").alias("cited_by"), "o_custkey", "o_orderkey")


DATED = """dated AS (SELECT 'ord:' || o_orderkey AS uid, strftime(o_orderdate, '%Y-%m-%d') AS date, lower(substr(o_orderpriority, 3, 20)) AS tier,
    o_orderstatus AS category, CAST(floor(o_totalprice) AS BIGINT) AS cited_by, o_custkey, o_orderkey FROM orders)"""


def seen(spark, sf) -> DataFrame:
    """events as search hits."""
    e = table(spark, sf, "events")
    day = F.date_format("ts", "yyyy-MM-dd")
    return e.select(F.col("user_id").alias("uid"), F.col("event_type").alias("group"), F.lit("events").alias("source"), day.alias("first_seen"), day.alias("last_seen"))


def case(rules: dict[str, str], default: str, column: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '{p}', 'i') THEN '{n}'" for n, p in rules.items()) + f" ELSE '{default}' END"


# ---------------------------------------------------------------- filters, sorts


@query("filter_date_window", f"WITH {DATED} SELECT uid, date, cited_by FROM dated WHERE date BETWEEN '1996-03-01' AND '1997-12-31'")
def _(spark, sf):
    return C.select(dated(spark, sf), date_from=S.parse_date("1996-03"), date_to=S.parse_date("1997", end=True)).select("uid", "date", "cited_by")


@query("filter_exact_token", f"WITH {DATED} SELECT uid, tier, category FROM dated WHERE tier IN ('urgent', 'high') AND lower(category) IN ('o', 'f')")
def _(spark, sf):
    return C.select(dated(spark, sf), tier="urgent, HIGH", category="o,f").select("uid", "tier", "category")


@query("filter_any_token", "SELECT p_partkey, p_type FROM part WHERE contains(lower(p_type), 'nom') OR contains(lower(p_type), 'mo')")
def _(spark, sf):
    p = table(spark, sf, "part")
    return p.filter(C.any_part(F.col("p_type"), "Nom, mo")).select("p_partkey", "p_type")


@query("filter_text_regex", f"WITH {WORKS} SELECT uid, title FROM works WHERE regexp_matches(title, '^(the|in|of) ', 'i')")
def _(spark, sf):
    return C.select(works(spark, sf), title="^(the|in|of) ").select("uid", "title")


@query("catalogue_filter_all", f"WITH {DATED} SELECT uid, date, tier, cited_by FROM dated WHERE date >= '1997-01-01' AND date <= '1999-06-30' AND tier IN ('urgent', 'medium') AND lower(category) IN ('p', 'o') ORDER BY cited_by DESC, uid LIMIT 50")
def _(spark, sf):
    return C.select(dated(spark, sf), date_from="1997-01-01", date_to=S.parse_date("1999-06", end=True), tier="urgent,medium", category="P,O", sort="cited_by", limit=50).select("uid", "date", "tier", "cited_by")


@query("sort_cited_limit", f"WITH {DATED} SELECT uid, cited_by FROM dated ORDER BY cited_by DESC, uid LIMIT 30")
def _(spark, sf):
    return C.select(dated(spark, sf), sort="cited_by", limit=30).select("uid", "cited_by")


LOOSE = r"(^|[^\p{L}\p{M}\p{Nd}\p{Pc}])%s(e?s)?([^\p{L}\p{M}\p{Nd}\p{Pc}]|$)"


@query("term_match_loose", f"SELECT doc_id FROM documents WHERE regexp_matches(text, '{LOOSE % 'with[ -]+the'}', 'i') OR (regexp_matches(text, '{LOOSE % 'und'}', 'i') AND regexp_matches(text, '{LOOSE % 'der'}', 'i'))")
def _(spark, sf):
    return table(spark, sf, "documents").filter(T.matches(F.col("text"), T.parse_topic('"with the", und & der'))).select("doc_id")


@query("context_window", r"""WITH m AS (SELECT doc_id, text, regexp_extract(text, '(?i)licen[sc]ed under') AS hit FROM documents WHERE regexp_matches(text, 'licen[sc]ed under', 'i'))
    SELECT doc_id, trim(regexp_replace(substr(text, CAST(greatest(instr(text, hit) - 80, 1) AS BIGINT), 160), '[ \t\n\r\f\v]+', ' ', 'g')) AS context FROM m""")
def _(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", C.context(F.col("text"), "licen[sc]ed under").alias("context")).filter("context IS NOT NULL")


# ---------------------------------------------------------------- scalars


@query("normalize_host", r"SELECT page_id, regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/?#:]+)', 1), '^(?:www|m)\.', '') AS host, regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '\?utm_[^#]*$', ''), '/+$', '') AS clean FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", S.host(F.col("url")).alias("host"), S.clean_url(F.col("url")).alias("clean"))


@query("make_uid", r"SELECT page_id, 'url:' || regexp_replace(regexp_replace(regexp_replace(lower(url), '^[a-z]+://', ''), '^www\.', ''), '/+$', '') AS uid FROM pages")
def _(spark, sf):
    e = F.lit("")
    return table(spark, sf, "pages").select("page_id", S.make_uid(e, e, e, e, F.col("url")).alias("uid"))


@query("normalize_doi", "SELECT o_orderkey, '10.1101/' || o_orderkey AS doi FROM orders")
def _(spark, sf):
    raw = F.concat(F.lit("https://DOI.org/10.1101/"), F.col("o_orderkey").cast("string"), F.lit("v2."))
    return table(spark, sf, "orders").select("o_orderkey", S.normalise_doi(raw).alias("doi"))


@query("clean_text", r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \t\n\r\f\v]+', ' ', 'g')) AS clean FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", S.clean_text(F.col("html")).alias("clean"))


@query("slugify", r"SELECT c_custkey, regexp_replace(substr(regexp_replace(regexp_replace(lower(c_name || ' in ' || c_mktsegment), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60), '-+$', '') AS slug FROM customer")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", S.topic_slug(F.concat("c_name", F.lit(" in "), "c_mktsegment")).alias("slug"))


@query("first_authors", """WITH a AS (SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS names, count(*) AS n FROM nation GROUP BY 1)
    SELECT n_regionkey, array_to_string(string_split(names, ', ')[1:3], ', ') || CASE WHEN n > 3 THEN ' et al.' ELSE '' END AS authors FROM a""")
def _(spark, sf):
    n = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ", ").alias("names"))
    return n.select("n_regionkey", S.first_authors(F.col("names")).alias("authors"))


@query("best_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%Y') || '-01-01' ELSE '' END AS best FROM orders")
def _(spark, sf):
    o = table(spark, sf, "orders")
    k, day = F.col("o_orderkey") % 3, F.date_format("o_orderdate", "yyyy-MM-dd")
    return o.select("o_orderkey", S.best_date(F.when(k == 0, day).otherwise("n/a"), F.when(k == 1, F.substring(day, 1, 4)).otherwise("")).alias("best"))


@query("work_key", f"WITH {WORKS} SELECT uid, concat_ws('|', regexp_replace(lower(title), '[^a-z0-9]+', '', 'g'), regexp_replace(lower(source), '[^a-z0-9]+', '', 'g'), lang) AS work FROM works")
def _(spark, sf):
    return works(spark, sf).select("uid", S.work_key(F.col("title"), F.col("source"), F.col("lang")).alias("work"))


@query("summary_provenance", r"""SELECT d.doc_id, substr(trim(regexp_replace(coalesce(b.text, d.text, ''), '[ \t\n\r\f\v]+', ' ', 'g')), 1, 2000) AS summary,
    CASE WHEN b.text IS NOT NULL THEN 'abstract' WHEN coalesce(d.text, '') <> '' THEN 'full text' ELSE '' END AS summary_from FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id""")
def _(spark, sf):
    d, b = table(spark, sf, "documents"), table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("abstract"))
    j = d.join(b, "doc_id", "left")
    label = F.when(F.col("abstract").isNotNull(), "abstract").when(S.text(F.col("text")) != "", "full text").otherwise("")
    return j.select("doc_id", F.substring(S.collapse(F.coalesce("abstract", "text")), 1, 2000).alias("summary"), label.alias("summary_from"))


# ---------------------------------------------------------------- merging and joins


@query("hit_merge", """SELECT user_id AS uid, event_type AS "group", 'events' AS source, strftime(min(ts), '%Y-%m-%d') AS first_seen, strftime(max(ts), '%Y-%m-%d') AS last_seen FROM events GROUP BY 1, 2""")
def _(spark, sf):
    return C.merge_hits(seen(spark, sf))


@query("record_merge_fields", """SELECT user_id, list_sort(list(DISTINCT event_type)) AS sources, max(value) AS cited_by,
    arg_max(event_type, event_id) FILTER (event_type <> 'view') AS newest, arg_min(event_type, event_id) FILTER (event_type <> 'click') AS oldest FROM events GROUP BY 1""")
def _(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", F.array("event_type").alias("sources"), F.col("value").alias("cited_by"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("newest"), F.when(F.col("event_type") != "click", F.col("event_type")).alias("oldest"))
    return C.merge_fields(e, "user_id", "event_id", lists=["sources"], largest=["cited_by"], newest=["newest"], oldest=["oldest"])


@query("alias_resolve", """WITH a AS (SELECT n_name AS alias, min(n_nationkey) AS target FROM nation GROUP BY 1)
    SELECT c_custkey AS uid, coalesce(x.target, r.target, c_custkey) AS resolved FROM customer JOIN nation n ON c_nationkey = n_nationkey
    LEFT JOIN a x ON x.alias = c_name LEFT JOIN a r ON r.alias = n.n_name""")
def _(spark, sf):
    n = table(spark, sf, "nation")
    aliases = n.groupBy(F.col("n_name").alias("alias")).agg(F.min("n_nationkey").cast("long").alias("target"))
    c = table(spark, sf, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))  # nations are a fixed list
    records = c.select(F.col("c_custkey").alias("uid"), F.array("c_name", "n_name").alias("keys"))
    return C.resolve_aliases(records, aliases).select("uid", "resolved")


@query("work_dedupe", f"WITH {WORKS} SELECT title, source, lang, min(doc_id) AS doc_id, count(*) AS versions FROM works GROUP BY 1, 2, 3")
def _(spark, sf):
    return works(spark, sf).groupBy("title", "source", "lang").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("versions"))


@query("keep_first", "SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, text) = 1")
def _(spark, sf):
    return C.keep_first(table(spark, sf, "conversations"), ["conv_id", "role"], ["turn", "text"]).select("conv_id", "turn", "role", "text")


@query("union_priority", "SELECT doc_id AS uid, coalesce(b.text, d.text) AS text FROM documents d LEFT JOIN benchmark b ON item_id = doc_id UNION ALL SELECT item_id, text FROM benchmark WHERE item_id NOT IN (SELECT doc_id FROM documents)")
def _(spark, sf):
    return C.union_priority([table(spark, sf, "documents").select(F.col("doc_id").alias("uid"), "text"), table(spark, sf, "benchmark").select(F.col("item_id").alias("uid"), "text")])


@query("carry_over", "SELECT doc_id AS uid, 'new' AS run FROM labels UNION ALL SELECT doc_id, 'old' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, sf):
    return C.carry_over(table(spark, sf, "documents").select(F.col("doc_id").alias("uid"), F.lit("old").alias("run")), table(spark, sf, "labels").select(F.col("doc_id").alias("uid"), F.lit("new").alias("run")))


@query("not_tried_anti", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left_anti").select("doc_id", "source")


@query("select_semi", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def _(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels").filter("quality = 0"), "doc_id", "left_semi").select("doc_id", "lang")


@query("pair_symmetric", "WITH p AS (SELECT s_suppkey AS a, s_nationkey + 1 AS b FROM supplier), u AS (SELECT a AS id, b AS other FROM p UNION SELECT b, a FROM p) SELECT id, min(other) AS other, count(*) AS n FROM u GROUP BY 1")
def _(spark, sf):
    p = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("a"), (F.col("s_nationkey") + 1).cast("long").alias("b"))
    both = p.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(p.select(F.col("b").alias("id"), F.col("a").alias("other"))).distinct()
    return both.groupBy("id").agg(F.min("other").alias("other"), F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- classification and the catalogue


@query("classify_first_match", f"SELECT doc_id, {case(CATEGORIES, 'prose', 'text')} AS category FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", C.first_match(F.col("text"), CATEGORIES, "prose").alias("category"))


@query("classify_multi_label", "SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}', 'i') THEN '{n}' END" for n, p in TAGS.items()) + "], lambda x: x IS NOT NULL), '; ') AS tags FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(C.all_matches(F.col("text"), TAGS), "; ").alias("tags"))


def _tiered(spark, sf):
    # classes are computed below the join, so that no filter above it computes them again
    w = works(spark, sf).withColumn("category", C.first_match(F.col("text"), CATEGORIES, "prose")).drop("text")
    w = w.join(table(spark, sf, "labels"), "doc_id", "left").withColumn("seed", F.col("quality").isNotNull())
    return w.withColumn("tier", C.tier(F.coalesce(F.col("toxic") == 1, F.lit(False)), F.coalesce(F.col("quality") == 1, F.lit(False)), F.col("category") == "prose", F.col("seed")))


TIERED = f"""{WORKS}, t AS (SELECT w.*, quality IS NOT NULL AS seed, {case(CATEGORIES, 'prose', 'text')} AS category,
    CASE WHEN toxic = 1 THEN 'landmark' WHEN quality = 1 AND {case(CATEGORIES, 'prose', 'text')} = 'prose' THEN 'core' WHEN quality = 1 THEN 'related'
         WHEN quality IS NOT NULL AND {case(CATEGORIES, 'prose', 'text')} = 'prose' THEN 'related' ELSE 'none' END AS tier FROM works w LEFT JOIN labels USING (doc_id))"""


@query("tier_assign", f"WITH {TIERED} SELECT uid, category, tier FROM t")
def _(spark, sf):
    return _tiered(spark, sf).select("uid", "category", "tier")


@query("route_counts", f"WITH {TIERED} SELECT CASE WHEN tier <> 'none' THEN 'catalogue' WHEN seed THEN 'off_topic_seed' WHEN lang = 'en' THEN 'broad' ELSE 'dropped' END AS route, count(*) AS n FROM t GROUP BY 1")
def _(spark, sf):
    r = C.route(F.col("tier"), F.lit(""), "2011-01-01", F.col("seed"), F.col("lang") == "en")
    return _tiered(spark, sf).groupBy(r.alias("route")).agg(F.count(F.lit(1)).alias("n"))


@query("catalogue_build", f"WITH {TIERED} SELECT uid, title, lang, source, category, tier FROM t WHERE tier <> 'none'")
def _(spark, sf):
    rows = _tiered(spark, sf).filter("tier <> 'none'").withColumn("date", F.lit(""))
    return C.catalogue_order(rows).select("uid", "title", "lang", "source", "category", "tier")


MERGE = f"""old AS (SELECT doc_id AS uid, lang AS title, '2024-01-01' AS added_on, 'note ' || source AS notes, '' AS status FROM documents WHERE n_chars < 3000),
    new AS (SELECT doc_id AS uid, source AS title FROM documents WHERE n_chars > 500),
    m AS (SELECT coalesce(new.uid, old.uid) AS uid, CASE WHEN new.uid IS NOT NULL THEN new.title ELSE old.title END AS title, coalesce(old.added_on, '{TODAY}') AS added_on,
    coalesce(old.notes, '') AS notes, CASE WHEN new.uid IS NULL THEN 'not matched in the last run' ELSE '' END AS status FROM old FULL JOIN new USING (uid))"""


def _merged(spark, sf):
    d = table(spark, sf, "documents")
    old = d.filter("n_chars < 3000").select(F.col("doc_id").alias("uid"), F.col("lang").alias("title"), F.lit("2024-01-01").alias("added_on"), F.concat(F.lit("note "), "source").alias("notes"), F.lit("").alias("status"))
    new = d.filter("n_chars > 500").select(F.col("doc_id").alias("uid"), F.col("source").alias("title"), F.lit("").alias("notes"), F.lit("").alias("status"))
    return C.merge_catalogue(old, new, TODAY)


@query("catalogue_merge", f"WITH {MERGE} SELECT * FROM m")
def _(spark, sf):
    return _merged(spark, sf)


@query("changelog_added", f"WITH {MERGE} SELECT uid, title, added_on FROM m WHERE added_on = '{TODAY}'")
def _(spark, sf):
    return _merged(spark, sf).filter(F.col("added_on") == TODAY).select("uid", "title", "added_on")


@query("pending_work", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1998-07-03' THEN 'retry' WHEN o_orderstatus = 'P' THEN 'deferred' ELSE '' END AS pending FROM orders")
def _(spark, sf):
    o = table(spark, sf, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "error").when(F.col("o_orderstatus") == "P", "deferred").otherwise("ok")
    late = C.due(F.date_format("o_orderdate", "yyyy-MM-dd"), status, "1998-08-02")
    return o.select("o_orderkey", F.when((status == "error") & late, "retry").when(status == "deferred", "deferred").otherwise("").alias("pending"))


# ---------------------------------------------------------------- analytics


@query("pivot_year_type", "SELECT year(o_orderdate) AS year, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
def _(spark, sf):
    return table(spark, sf, "orders").groupBy(F.year("o_orderdate").cast("long").alias("year")).pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)


@query("pivot_year_label", "WITH l AS (SELECT doc_id, unnest(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}', 'i') THEN '{n}' END" for n, p in TAGS.items()) + "], lambda x: x IS NOT NULL)) AS tag, source FROM documents) SELECT source, " + ", ".join(f"count(*) FILTER (tag = '{n}') AS {n}" for n in TAGS) + " FROM l GROUP BY 1")
def _(spark, sf):
    d = table(spark, sf, "documents").select("source", F.explode(C.all_matches(F.col("text"), TAGS)).alias("tag"))
    return d.groupBy("source").pivot("tag", list(TAGS)).count().na.fill(0)


@query("growth_table", f"WITH {DATED} SELECT substr(date, 1, 4) AS year, count(*) FILTER (tier = 'urgent') AS urgent, count(*) FILTER (tier = 'high') AS high, count(*) AS total FROM dated GROUP BY 1")
def _(spark, sf):
    return dated(spark, sf).groupBy(F.substring("date", 1, 4).alias("year")).agg(F.count_if(F.col("tier") == "urgent").alias("urgent"), F.count_if(F.col("tier") == "high").alias("high"), F.count(F.lit(1)).alias("total"))


@query("status_counts", "SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1")
def _(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value")


@query("coverage_table", f"WITH {TIERED} SELECT tier, category, count(*) AS n, count(DISTINCT source) AS sources FROM t GROUP BY 1, 2")
def _(spark, sf):
    return _tiered(spark, sf).groupBy("tier", "category").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("sources"))


@query("first_seen_entity", "SELECT event_type, arg_min(event_id, (ts, event_id)) AS first_event, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def _(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.min(F.struct("ts", "event_id"))["event_id"].alias("first_event"), F.countDistinct("user_id").alias("users"))


@query("topk_overall", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 30")
def _(spark, sf):
    return table(spark, sf, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(30).select("p_partkey", "p_retailprice")


@query("topk_per_group", f"WITH {DATED} SELECT tier, uid, cited_by FROM dated QUALIFY row_number() OVER (PARTITION BY tier ORDER BY cited_by DESC, uid) <= 5")
def _(spark, sf):
    w = Window.partitionBy("tier").orderBy(F.desc("cited_by"), "uid")
    return dated(spark, sf).withColumn("rn", F.row_number().over(w)).filter("rn <= 5").select("tier", "uid", "cited_by")


@query("latest_version", "SELECT l_orderkey, arg_max(l_partkey, (l_shipdate, l_linenumber, l_partkey)) AS part, max(l_shipdate) AS latest FROM lineitem GROUP BY 1")
def _(spark, sf):
    m = F.max(F.struct("l_shipdate", "l_linenumber", "l_partkey"))
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(m["l_partkey"].alias("part"), F.max("l_shipdate").alias("latest"))


@query("attachment_summary", """WITH e AS (SELECT l_orderkey, l_returnflag AS ext, count(*) AS n, count(*) FILTER (l_linestatus = 'F') AS k FROM lineitem GROUP BY 1, 2)
    SELECT l_orderkey, sum(k)::BIGINT || '/' || sum(n)::BIGINT || ': ' || string_agg(ext || ' ' || n, ', ' ORDER BY ext) AS summary FROM e GROUP BY 1""")
def _(spark, sf):
    e = table(spark, sf, "lineitem").groupBy("l_orderkey", F.col("l_returnflag").alias("ext")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_linestatus") == "F").alias("k"))
    g = e.groupBy("l_orderkey").agg(F.sum("k").alias("ok"), F.sum("n").alias("total"), F.collect_list(F.struct("ext", "n")).alias("x"))
    return g.select("l_orderkey", S.attachment_summary(F.col("ok"), F.col("total"), F.col("x")).alias("summary"))


@query("extension_stats", "SELECT l_returnflag AS ext, count(*) AS total, count(*) FILTER (l_linestatus = 'F') AS ok, count(DISTINCT l_orderkey) AS papers FROM lineitem GROUP BY 1")
def _(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("ext")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("l_linestatus") == "F").alias("ok"), F.countDistinct("l_orderkey").alias("papers"))


# ---------------------------------------------------------------- mining


@query("page_title", r"SELECT page_id, substr(trim(regexp_replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '""'), '&#39;', ''''), '&amp;', '&'), '[ \t\n\r\f\v]+', ' ', 'g')), 1, 300) AS title FROM pages".replace('\'""\'', "'\"'"))
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", M.page_title(F.col("html")).alias("title"))


HREFS = r"""h AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS root, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS href FROM pages),
    l AS (SELECT page_id, CASE WHEN href[1] = '/' THEN root || href ELSE href END AS url FROM h)"""


@query("link_extract", f"WITH {HREFS} SELECT page_id, url, count(*) AS n FROM l GROUP BY 1, 2")
def _(spark, sf):
    return M.hrefs(table(spark, sf, "pages")).groupBy("page_id", "url").agg(F.count(F.lit(1)).alias("n"))


@query("domain_candidates", f"""WITH {HREFS}, d AS (SELECT page_id, url, regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/?#:]+)', 1), '^(?:www|m)\\.', '') AS domain FROM l),
    u AS (SELECT domain, url, count(*) AS n FROM d GROUP BY 1, 2),
    top AS (SELECT domain, url AS top_url FROM u QUALIFY row_number() OVER (PARTITION BY domain ORDER BY n DESC, url) = 1)
    SELECT domain, count(DISTINCT page_id) AS n_papers, count(DISTINCT url) AS n_urls, any_value(top_url) AS top_url,
    array_to_string(list_sort(list(DISTINCT page_id))[1:5], '; ') AS examples FROM d JOIN top USING (domain) GROUP BY 1""")
def _(spark, sf):
    d = M.hrefs(table(spark, sf, "pages")).withColumn("domain", S.host(F.col("url")))
    u = d.groupBy("domain", "url").agg(F.count(F.lit(1)).alias("n"))
    top = u.groupBy("domain").agg(F.min(F.struct((-F.col("n")).alias("m"), "url"))["url"].alias("top_url"), F.count(F.lit(1)).alias("n_urls"))
    pages = d.select("domain", "page_id").distinct()
    five = pages.withColumn("rn", F.row_number().over(Window.partitionBy("domain").orderBy("page_id"))).filter("rn <= 5")  # limited a task before the shuffle
    five = five.groupBy("domain").agg(F.array_join(F.array_sort(F.collect_list("page_id")).cast("array<string>"), "; ").alias("examples"))
    g = pages.groupBy("domain").agg(F.count(F.lit(1)).alias("n_papers")).join(five, "domain")
    return g.join(top, "domain").select("domain", "n_papers", "n_urls", "top_url", "examples")


@query("jats_markdown", r"""SELECT doc_id, '# Document ' || doc_id || chr(10) || chr(10) || CASE WHEN t = '' THEN '## Text' ELSE '## Text' || chr(10) || chr(10) || t END || chr(10) AS markdown
    FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[ \t\n\r\f\v]+', ' ', 'g')) AS t FROM documents)""".replace("\\\\", "\\"))
def _(spark, sf):
    d = table(spark, sf, "documents")
    esc = F.replace(F.replace(S.text(F.col("text")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    xml = F.concat(F.lit("<article><front><article-meta><article-title>"), F.lit("Document "), F.col("doc_id").cast("string"), F.lit("</article-title></article-meta></front><body><sec><title>Text</title><p>"), esc, F.lit("</p></sec></body></article>"))
    return X.markdown(d.select("doc_id", xml.alias("xml")), "doc_id", "xml").select("doc_id", "markdown")


from quarrylark.plans import answers, assembled, coverage, late, references, resolved, state  # noqa: E402, F401  (they register their queries)
