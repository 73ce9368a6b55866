"""Citation queries: orders as references with one to twelve authors, every optional field empty in some rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylark.operators import citations as R
from quarrylark.plans.registry import DATED, dated, query, table


def cited(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    c = table(spark, sf, "customer").join(F.broadcast(n), "c_nationkey")  # nations are a fixed list
    k = F.col("o_orderkey")
    d = dated(spark, sf).join(c.select(F.col("c_custkey").alias("o_custkey"), "c_name", "n_name", "c_mktsegment"), "o_custkey")
    more = F.transform(F.sequence(F.lit(1), (k % 12).cast("int")), lambda i: F.concat(F.lit("Writer"), F.char(F.lit(64) + i), F.lit(" XY")))
    people = F.concat(F.array(F.concat(F.initcap("n_name"), F.lit(" AB"))), F.when(k % 12 > 0, more).otherwise(F.array().cast("array<string>")))
    some = lambda m, x: F.when(k % m == 0, "").otherwise(x)
    digits = lambda m, plus=0: (k % m + plus).cast("string")
    return d.select(
        "uid", "date", F.when(k % 5 == 0, "preprint").otherwise("article").alias("resource_type"), F.array_join(people, ", ").alias("authors"),
        F.substring("date", 1, 4).alias("year"), F.concat(F.lit("On "), F.lower("c_mktsegment")).alias("title"), F.col("n_name").alias("venue"),
        some(2, digits(90)).alias("volume"), some(3, digits(7)).alias("issue"), some(7, F.concat(digits(100), F.lit("-"), digits(100, 9))).alias("pages"),
        some(11, F.concat(F.lit("10.1/"), k.cast("string"))).alias("doi"), F.lit("").alias("pmid"), F.concat(F.lit("https://x.org/"), k.cast("string")).alias("url"), "o_orderkey",
    )


CITED = f"""{DATED}, c0 AS (SELECT uid, date, o_orderkey AS k, upper(n_name[1]) || lower(substr(n_name, 2)) AS fam, list_transform(range(1, o_orderkey % 12 + 1), lambda i: 'Writer' || chr(CAST(64 + i AS INTEGER))) AS ws,
    substr(date, 1, 4) AS year, 'On ' || lower(c_mktsegment) AS title, n_name AS venue FROM dated JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
    c AS (SELECT *, 1 + len(ws) AS n, CASE WHEN k % 5 = 0 THEN 'preprint' ELSE 'article' END AS resource_type, CASE WHEN k % 2 = 0 THEN '' ELSE CAST(k % 90 AS VARCHAR) END AS vol, CASE WHEN k % 3 = 0 THEN '' ELSE CAST(k % 7 AS VARCHAR) END AS iss,
    CASE WHEN k % 7 = 0 THEN '' ELSE (k % 100) || '-' || (k % 100 + 9) END AS pg, CASE WHEN k % 11 = 0 THEN '' ELSE '10.1/' || k END AS doi, CASE WHEN k % 11 = 0 THEN 'https://x.org/' || k ELSE 'https://doi.org/10.1/' || k END AS link,
    [fam || ', A. B.'] || list_transform(ws, lambda w: w || ', X. Y.') AS inv, [fam || ', A.B.'] || list_transform(ws, lambda w: w || ', X.Y.') AS har, [fam || ' AB'] || list_transform(ws, lambda w: w || ' XY') AS com,
    [fam || ', A. B.'] || list_transform(ws, lambda w: 'X. Y. ' || w) AS mix, ['A. B. ' || fam] || list_transform(ws, lambda w: 'X. Y. ' || w) AS fwd FROM c0),
    s AS (SELECT *, CASE WHEN vol = '' THEN '' ELSE ', ' || vol END || CASE WHEN iss = '' THEN '' ELSE '(' || iss || ')' END AS vi, CASE WHEN pg = '' THEN '' ELSE ', ' || pg END AS cpg,
    year || CASE WHEN vol = '' THEN '' ELSE ';' || vol END || CASE WHEN iss = '' THEN '' ELSE '(' || iss || ')' END || CASE WHEN pg = '' THEN '' ELSE ':' || pg END || '. ' || CASE WHEN doi = '' THEN link ELSE 'doi:' || doi END AS med FROM c)"""


def people(names: str, two: str, more: str, whole: int, cut: int, tail: str) -> str:
    """SQL of an author list."""
    return f"CASE WHEN n = 1 THEN {names}[1] WHEN n > {whole} THEN array_to_string({names}[1:{cut}], ', ') || '{tail}' ELSE array_to_string({names}[1:n-1], ', ') || CASE WHEN n = 2 THEN '{two}' ELSE '{more}' END || {names}[-1] END"


def has(column: str, before: str, after: str = "") -> str:
    return f"CASE WHEN {column} = '' THEN '' ELSE '{before}' || {column} || '{after}' END"


SQL = {
    "APA": f"{people('inv', ', & ', ', & ', 20, 19, '')} || ' (' || year || '). ' || title || '. ' || venue || vi || cpg || '. ' || link",
    "AMA": f"rtrim({people('com', ', ', ', ', 6, 3, ', et al')}, '.') || '. ' || title || '. ' || venue || '. ' || med",
    "VAN": f"rtrim({people('com', ', ', ', ', 6, 6, ', et al.')}, '.') || '. ' || title || '. ' || venue || '. ' || med",
    "MLA": f"rtrim({people('mix', ', and ', ', and ', 2, 1, ', et al.')}, '.') || '. \"' || title || '.\" ' || venue || {has('vol', ', vol. ')} || {has('iss', ', no. ')} || ', ' || year || {has('pg', ', pp. ')} || '. ' || link || '.'",
    "HAR": f"{people('har', ' and ', ' and ', 3, 1, ' et al.')} || ' (' || year || ') ''' || title || ''', ' || venue || vi || {has('pg', ', pp. ')} || '.' || CASE WHEN doi = '' THEN ' Available at: ' || link ELSE ' doi:' || doi END || '.'",
    "CHI": f"rtrim({people('mix', ', and ', ', and ', 10, 7, ', et al.')}, '.') || '. ' || year || '. \"' || title || '.\" ' || venue || {has('vol', ' ')} || {has('iss', ' (', ')')} || {has('pg', ': ')} || '. ' || link || '.'",
    "IEE": f"{people('fwd', ' and ', ', and ', 6, 1, ' et al.')} || ', \"' || title || ',\" ' || venue || {has('vol', ', vol. ')} || {has('iss', ', no. ')} || {has('pg', ', pp. ')} || ', ' || year || CASE WHEN doi = '' THEN '. [Online]. Available: ' || link ELSE ', doi: ' || doi END || '.'",
    "NAT": f"{people('inv', ' & ', ' & ', 5, 1, ' et al.')} || ' ' || title || '. ' || venue || {has('vol', ' ')} || cpg || ' (' || year || '). ' || link",
    "ENW": f"'%0 ' || CASE resource_type WHEN 'article' THEN 'Journal Article' ELSE 'Unpublished Work' END || chr(10) || array_to_string(list_transform(inv, lambda a: '%A ' || a), chr(10)) || replace('|%T ' || title || CASE resource_type WHEN 'article' THEN '|%J ' ELSE '|%B ' END || venue || '|%D ' || year || {has('vol', '|%V ')} || {has('iss', '|%N ')} || {has('pg', '|%P ')} || {has('doi', '|%R ')} || '|%U ' || link, '|', chr(10))",
    "RIS": f"'TY  - ' || CASE resource_type WHEN 'article' THEN 'JOUR' ELSE 'UNPB' END || chr(10) || array_to_string(list_transform(inv, lambda a: 'AU  - ' || a), chr(10)) || replace('|TI  - ' || title || '|T2  - ' || venue || '|PY  - ' || year || '|DA  - ' || replace(date, '-', '/') || {has('vol', '|VL  - ')} || {has('iss', '|IS  - ')} || CASE WHEN pg = '' THEN '' ELSE '|SP  - ' || split_part(pg, '-', 1) || '|EP  - ' || split_part(pg, '-', 2) END || {has('doi', '|DO  - ')} || '|UR  - ' || link || '|ER  - ', '|', chr(10))",
}
NAMES = {"APA": "cite_apa", "AMA": "cite_ama", "VAN": "cite_vancouver", "MLA": "cite_mla", "HAR": "cite_harvard", "CHI": "cite_chicago", "IEE": "cite_ieee", "NAT": "cite_nature", "ENW": "cite_endnote", "RIS": "cite_ris", "BIB": "cite_bibtex", "CSL": "cite_csl"}

field = lambda name, value, when="true": f"CASE WHEN {when} AND {value} <> '' THEN '  {name} = {{' || {value} || '}}' END"
item = lambda name, value: f"CASE WHEN {value} <> '' THEN '\"{name}\":\"' || {value} || '\"' END"
WHOLE = {
    "BIB": f"""WITH {CITED}, b AS (SELECT *, regexp_replace(lower(fam), '[^a-z0-9]', '', 'g') || year || 'on' AS base FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY k) AS nth, replace(venue, chr(95), chr(92) || chr(95)) AS latex_venue, resource_type = 'article' AS art FROM b)
    SELECT uid, '@' || CASE WHEN art THEN 'article' ELSE 'misc' END || '{{' || base || CASE WHEN nth = 1 THEN '' ELSE chr(CAST(97 + least(nth - 2, 25) AS INTEGER)) END || ',' || chr(10) || concat_ws(',' || chr(10), {field("author", "array_to_string(inv, ' and ')")},
    '  title = {{{{' || title || '}}}}', {field("journal", "latex_venue", "art")}, {field("howpublished", "latex_venue", "NOT art")}, {field("year", "year")}, {field("volume", "vol")}, {field("number", "iss")}, {field("pages", "replace(pg, '-', '--')")}, {field("doi", "doi")}, {field("url", "link")}, {field("note", "resource_type", "NOT art")})
    || chr(10) || '}}' AS text FROM r""",
    "CSL": f"""WITH {CITED} SELECT uid, '{{' || concat_ws(',', {item("DOI", "doi")}, {item("URL", "link")}, '"author":[' || array_to_string(list_transform(inv, lambda a: '{{"family":"' || split_part(a, ', ', 1) || '","given":"' || split_part(a, ', ', 2) || '"}}'), ',') || ']',
    {item("container-title", "venue")}, {item("id", "uid")}, {item("issue", "iss")}, '"issued":{{"date-parts":[[' || CAST(substr(date, 1, 4) AS INTEGER) || ',' || CAST(substr(date, 6, 2) AS INTEGER) || ',' || CAST(substr(date, 9, 2) AS INTEGER) || ']]}}',
    {item("page", "pg")}, {item("title", "title")}, '"type":"' || CASE resource_type WHEN 'article' THEN 'article-journal' ELSE 'article' END || '"', {item("volume", "vol")}) || '}}' AS text FROM s""",
}

for _code, _name in NAMES.items():
    query(_name, WHOLE.get(_code) or f"WITH {CITED} SELECT uid, {SQL[_code]} AS text FROM s")(lambda spark, sf, code=_code: R.render(cited(spark, sf), code, ["o_orderkey"], numbered=False))


@query("cite_numbered", f"WITH {CITED}, p AS (SELECT *, row_number() OVER (ORDER BY date, uid) AS place FROM s) SELECT uid, place AS n, '[' || place || '] ' || {SQL['IEE'].replace('n = ', 's_n = ').replace('n > ', 's_n > ').replace('n-1', 's_n-1')} AS text FROM (SELECT *, n AS s_n FROM p)")
def _(spark, sf):
    return R.render(cited(spark, sf), "IEE", ["date", "uid"])


@query("cite_bibtex_key", f"""WITH {CITED}, b AS (SELECT uid, k, regexp_replace(lower(fam), '[^a-z0-9]', '', 'g') || year || 'on' AS base FROM c),
    r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY k) AS n FROM b)
    SELECT uid, base || CASE WHEN n = 1 THEN '' ELSE chr(CAST(97 + least(n - 2, 25) AS INTEGER)) END AS cite_key FROM r""")
def _(spark, sf):
    return R.bibtex_keys(cited(spark, sf), ["o_orderkey"]).select("uid", "cite_key")
