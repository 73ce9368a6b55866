"""The overview table, the findings document and the report page."""

from __future__ import annotations

import base64
import gzip
import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylark.functions import scalars as S
from quarrylark.operators.catalogue import due
from quarrylark.operators.postings import search as find
from quarrylark.sources.io import markdown_table

SUMMARY_MAX = 2000
# Types that can have a full text.
PAPERS = ["article", "review", "preprint", "report", "thesis", "conference paper", "book chapter"]


def pending(kind: Column, pmcid: Column, known: Column, status: Column, checked: Column, index_attachments: Column, failed: Column, listed: Column, today: str) -> Column:
    """What is still to be fetched for a paper: its full text, its attachments, each for the first time or again.

    failed and listed say whether any attachment has failed, or is listed for another reason than an extension nobody wants.
    """
    s, seen = S.text(status), F.coalesce(known, F.lit(False))
    again = s.isin("partial", "deferred", "error") | ((s == "none") & due(checked, status, today))
    text = F.when(~seen, "full text").when(again, "full text (retry)")
    media = F.when((S.text(pmcid) != "") & ~s.isin("none", "removed"), F.when(F.coalesce(failed, F.lit(False)), "attachments (retry)").when((S.text(index_attachments) == "") | F.coalesce(listed, F.lit(False)), "attachments"))
    return F.when(kind.isin(PAPERS), F.concat_ws("; ", text, media)).otherwise("")


def rows(catalogue: DataFrame, records: DataFrame, index: DataFrame, attachments: DataFrame, descriptions: DataFrame, today: str) -> DataFrame:
    """Catalogue rows with summary, summary_from, keywords, fulltext_sources and pending. index has a text column with the start of the full text."""
    c = F.col
    files = attachments.groupBy("uid").agg(F.max(c("status") == "failed").alias("_failed"), F.max((c("status") == "listed") & (S.text(c("reason")) != "extension not selected")).alias("_listed"))
    j = (
        catalogue.join(records.select("uid", *[c(x).alias(f"_{x}") for x in ("abstract", "keywords", "mesh", "pmcid", "epmc_ids", "oa_pdf_url")]), "uid", "left")
        .join(index.select("uid", F.lit(True).alias("_known"), c("status").alias("_status"), c("checked_on").alias("_checked"), c("attachments").alias("_att"), c("text").alias("_text")), "uid", "left")
        .join(files, "uid", "left")
        .join(descriptions.select("uid", c("description").alias("_desc")), "uid", "left")
    )
    texts = [(S.collapse(c("_abstract")), "abstract"), (S.collapse(F.substring(S.text(c("_text")), 1, 20000)), "fulltext"), (S.collapse(c("_desc")), "description")]
    found = F.coalesce(*[F.when(t != "", F.struct(F.substring(t, 1, SUMMARY_MAX).alias("t"), F.lit(n).alias("n"))) for t, n in texts])
    j = j.withColumn("_s", found)
    paper = c("resource_type").isin(PAPERS)
    return j.select(
        *catalogue.columns, S.text(c("_s.t")).alias("summary"), S.text(c("_s.n")).alias("summary_from"), S.keyword_union(c("_keywords"), c("_mesh")).alias("keywords"),
        F.when(paper, S.fulltext_sources(c("doi"), c("_pmcid"), c("_epmc_ids"), c("_oa_pdf_url"))).otherwise("").alias("fulltext_sources"),
        pending(c("resource_type"), c("_pmcid"), c("_known"), c("_status"), c("_checked"), c("_att"), c("_failed"), c("_listed"), today).alias("pending"),
    )


def finding_tables(catalogue: DataFrame, top: int = 30) -> dict[str, tuple[DataFrame, list]]:
    """Tables of a catalogue's findings with their orders: growth, most cited (also of each layer), layers over time, newest, coverage.

    Each has as many rows as there are years, layers or tiers, or a top few.
    """
    c = F.col
    papers = catalogue.filter(c("resource_type").isin(PAPERS))
    cited = [S.integer(c("cited_by")).desc(), c("uid")]
    tiers = [F.count_if(c("tier") == t).alias(t) for t in ("landmark", "core", "related")]
    kinds = [F.count_if(c("resource_type") == t).alias(t) for t in ("article", "review", "preprint")]
    layer = papers.withColumn("layer", F.explode(S.list_items(c("modality"))))
    five = layer.withColumn("place", F.row_number().over(Window.partitionBy("layer").orderBy(*cited))).filter("place <= 5")  # limited a task before the shuffle
    states = [F.count_if(S.text(c("fulltext_status")) == s).alias(s) for s in ("ok", "partial", "deferred", "none")]
    return {
        "Growth": (papers.filter(S.text(c("year")) != "").groupBy("year").agg(*kinds, *tiers, F.count(F.lit(1)).alias("total")), ["year"]),
        "Most cited": (papers.orderBy(*cited).limit(top).select("date", "title", "cited_by"), [S.integer(c("cited_by")).desc(), "date", "title"]),
        "Most cited of each layer": (five.select("layer", "place", "title", "cited_by"), ["layer", "place"]),
        "Layers over time": (layer.filter(c("tier").isin("landmark", "core")).groupBy("year", "layer").agg(F.count(F.lit(1)).alias("papers")), ["year", "layer"]),
        "Newest": (papers.orderBy(c("date").desc(), "uid").limit(10).select("date", "title"), [c("date").desc(), "title"]),
        "Coverage": (papers.groupBy("tier").agg(F.count(F.lit(1)).alias("papers"), *states), ["tier"]),
    }


def finding_rows(catalogue: DataFrame, top: int = 30) -> DataFrame:
    """table, cells (joined by bars) of all findings, without any of them on the driver."""
    parts = [df.select(F.lit(title).alias("table"), F.concat_ws(" | ", *[F.col(x).cast("string") for x in df.columns]).alias("cells")) for title, (df, _) in finding_tables(catalogue, top).items()]
    return reduce(DataFrame.unionByName, parts)


def findings(catalogue: DataFrame, top: int = 30) -> str:
    """Markdown of a catalogue's findings. Only aggregates and top rows come to the driver."""
    tables = finding_tables(catalogue, top).items()
    return "\n".join(f"## {title}\n\n" + markdown_table(df.columns, df.orderBy(*order).collect()) for title, (df, order) in tables)


# Kinds of rows that are code or data, and those that are sites.
CODE_ROWS = ["repository", "software package", "software", "archive", "dataset"]
SITE_ROWS = ["website", "database", "web calculator"]


def tiles(catalogue: DataFrame, run_date: str) -> DataFrame:
    """One row of counts for the head of the report, in one pass."""
    c = F.col
    paper = c("resource_type").isin(PAPERS)
    status = lambda *s: F.count_if(paper & S.text(c("fulltext_status")).isin(*s))
    return catalogue.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(c("added_on") == run_date).alias("added"), F.count_if(paper).alias("papers"), F.count_if(paper & (c("summary_from") == "abstract")).alias("with_abstract"),
        status("ok").alias("ok"), status("none", "error", "removed").alias("missing"), F.count_if(S.text(c("pending")) != "").alias("pending"), F.count_if(c("resource_type").isin(CODE_ROWS)).alias("code"),
        F.count_if(c("resource_type").isin(SITE_ROWS)).alias("sites"), F.coalesce(F.sum(F.size(S.list_items(c("code_links")))), F.lit(0)).alias("links"),
    )


def entity_mentions(catalogue: DataFrame, top: int = 60) -> DataFrame:
    """entity, n: how many rows name it, the part of a registry left out; the most named first."""
    own = F.regexp_replace(S.text(F.col("entities")), "^[^;]* registry: [^;]*;?", "")
    each = catalogue.select(F.explode(S.list_items(own)).alias("entity"))
    return each.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "entity").limit(top)


def origin_timeline(catalogue: DataFrame) -> DataFrame:
    """date, uid, ids of papers that introduced an entry of a registry, the undated last."""
    entry = r"([^;]*) registry: ([^;]*)"
    text = S.text(F.col("entities"))
    ids = F.substring(F.concat(F.trim(F.regexp_extract(text, entry, 1)), F.lit(": "), F.regexp_extract(text, entry, 2)), 1, 90)
    rows = catalogue.filter(text.rlike(entry)).select("date", "uid", ids.alias("ids"))
    return rows.orderBy(F.when(S.text(F.col("date")) == "", "9999").otherwise(F.col("date")), "uid")


def reasons(index: DataFrame) -> DataFrame:
    """reason, n of what has no full text; what stands in brackets at the end is left out, and pending reasons count each."""
    each = index.select(F.explode(S.list_items(F.col("reason"))).alias("r"))
    return each.groupBy(F.regexp_replace("r", r"\s*\([^()]*\)$", "").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def last_builds(runs: DataFrame, n: int = 5) -> DataFrame:
    """The last builds, oldest first."""
    return runs.orderBy(F.desc("run_date"), F.desc("rows_total")).limit(n).orderBy("run_date", "rows_total")


def newest(catalogue: DataFrame, n: int = 10) -> DataFrame:
    return catalogue.orderBy(F.desc(S.text(F.col("date"))), "uid").limit(n).select("date", "uid")


def page(df: DataFrame, sort: str, descending: bool = False, number: int = 1, size: int = 100, numeric: tuple[str, ...] = ("cited_by",)) -> DataFrame:
    """One page of the report's table, sorted by a column, numbers as numbers; equal rows by uid."""
    key = S.integer(F.col(sort)) if sort in numeric else F.lower(S.text(F.col(sort)))
    return df.orderBy(key.desc() if descending else key.asc(), "uid").offset((number - 1) * size).limit(size)


def layers_over_time(catalogue: DataFrame) -> DataFrame:
    """year, layer, papers: landmark and core papers by year and each of their layers."""
    rows = catalogue.filter(F.col("resource_type").isin(PAPERS) & F.col("tier").isin("landmark", "core"))
    return rows.withColumn("layer", F.explode(S.list_items(F.col("modality")))).groupBy("year", "layer").agg(F.count(F.lit(1)).alias("papers"))


def search(df: DataFrame, words: str, columns: list[str], **equal: str) -> DataFrame:
    """Rows that hold every word somewhere in the columns, and the given values."""
    hay = F.lower(F.concat_ws(" ", *[S.text(F.col(x)) for x in columns]))
    for word in words.lower().split():
        df = df.filter(hay.contains(word))
    for name, value in equal.items():
        if value:
            df = df.filter(F.col(name) == value)
    return df


#: Columns that the report's words are looked for in.
SEARCHED = ["title", "authors", "venue", "doi", "summary", "keywords", "fulltext_reason", "uid", "entities", "category"]


def chosen(df: DataFrame, words: str = "", kind: str = "", tier: str = "", fulltext: str = "", year_from: int = 0, year_to: int = 0, attachments: bool = False, new_on: str = "", index: str = "", key: str = "uid") -> DataFrame:
    """Rows by the report's selectors: all words, type, tier, full-text status ('not tried' is none), years, attachments that are there, added on a day.

    A bound of years leaves out rows without a year. With an index of the searched columns (`postings.build`) only its matching
    postings are read for the words, and no row's text.
    """
    c, where = F.col, []
    year = F.regexp_extract(F.coalesce(F.nullif(S.text(c("year")), F.lit("")), F.substring(S.text(c("date")), 1, 4)), r"^\s*([+-]?\d+)", 1).try_cast("int")
    where += [c(n) == v for n, v in (("resource_type", kind), ("tier", tier)) if v]
    if fulltext:
        where.append(F.coalesce(F.nullif(S.text(c("fulltext_status")), F.lit("")), F.lit("not tried")) == fulltext)
    where += [year >= year_from] if year_from else []
    where += [year <= year_to] if year_to else []
    if attachments:
        where.append(S.text(c("attachments")).rlike(r"^\d+/[1-9]"))
    if new_on:
        where.append(c("added_on") == new_on)
    for w in where:
        df = df.filter(w)
    if not words.split():
        return df
    if index:
        return df.join(find(df.sparkSession, index, words, "_found"), c(key) == c("_found"), "left_semi")
    return search(df, words, [x for x in SEARCHED if x in df.columns])


PAGE = """<!doctype html><meta charset="utf-8"><title>{title}</title><h1>{title}</h1><input id="q" placeholder="all these words"><p id="n"></p><p><button id="back">back</button> <span id="p"></span> <button id="next">next</button></p><table id="t"></table>
<script type="application/octet-stream" id="data">{data}</script>
<script>
(async () => {{
  const bytes = Uint8Array.from(atob(document.getElementById("data").textContent), c => c.charCodeAt(0));
  const table = await new Response(new Blob([bytes]).stream().pipeThrough(new DecompressionStream("gzip"))).json();
  const SIZE = 100; let at = 0, by = {{ column: null, sign: 1 }};
  const show = () => {{
    const words = document.getElementById("q").value.toLowerCase().split(/\\s+/).filter(Boolean);
    const hits = table.rows.filter(r => words.every(w => r.join(" ").toLowerCase().includes(w)));
    document.getElementById("n").textContent = hits.length + " of " + table.rows.length;
    const body = document.getElementById("t"); body.replaceChildren();
    const value = r => {{ const v = r[by.column]; return v !== "" && !isNaN(v) ? Number(v) : String(v).toLowerCase(); }};
    if (by.column !== null) hits.sort((a, b) => {{ const x = value(a), y = value(b); return by.sign * (typeof x !== typeof y ? (typeof x === "number" ? -1 : 1) : x < y ? -1 : x > y ? 1 : 0); }});
    const pages = Math.max(1, Math.ceil(hits.length / SIZE)); at = Math.min(at, pages - 1);
    const head = body.insertRow();
    table.columns.forEach((c, i) => {{ const th = head.insertCell(); th.textContent = c; th.onclick = () => {{ by = {{ column: i, sign: by.column === i ? -by.sign : 1 }}; show(); }}; }});
    for (const r of hits.slice(at * SIZE, (at + 1) * SIZE)) {{ const tr = body.insertRow(); for (const v of r) tr.insertCell().textContent = v; }}
    document.getElementById("p").textContent = "page " + (at + 1) + " of " + pages;
  }};
  document.getElementById("q").oninput = () => {{ at = 0; show(); }};
  document.getElementById("back").onclick = () => {{ at = Math.max(0, at - 1); show(); }};
  document.getElementById("next").onclick = () => {{ at += 1; show(); }};
  show();
}})();
</script>
"""


def report_page(df: DataFrame, title: str, columns: list[str], cuts: dict[str, int] | None = None) -> str:
    """One page with all rows, packed; texts cut by column. The page holds the table, so that its size is the caller's to choose."""
    cells = [F.substring(S.text(F.col(x)), 1, (cuts or {}).get(x, 1 << 30)).alias(x) for x in columns]
    data = json.dumps({"columns": columns, "rows": [list(r) for r in df.select(cells).toLocalIterator()]}, ensure_ascii=False)
    safe = title.replace("&", "&amp;").replace("<", "&lt;")
    return PAGE.format(title=safe, data=base64.b64encode(gzip.compress(data.encode(), mtime=0)).decode())


def report_rows(page: str) -> dict:
    """What a page holds."""
    packed = page.split('id="data">', 1)[1].split("</script>", 1)[0]
    return json.loads(gzip.decompress(base64.b64decode(packed)))
