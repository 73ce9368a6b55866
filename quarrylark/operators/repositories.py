"""What is known of code repositories: hits and links gathered by repository, releases, and answers that are still fresh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylark.functions import scalars as S

# Fixed value: days for which an answer about a repository is used again.
RECHECK_DAYS = 30


def repository_key(url: Column) -> Column:
    """owner/name in lower case of a GitHub address, or empty."""
    path = r"(?i)^https?://(?:www\.)?github\.com/([\w.-]+)/([\w.-]+)"
    name = F.regexp_replace(F.regexp_extract(S.text(url), path, 2), r"(?s).git$", "")
    return F.when(S.text(url).rlike(path), F.lower(F.concat_ws("/", F.regexp_extract(S.text(url), path, 1), name))).otherwise("")


def searched(hits: DataFrame) -> DataFrame:
    """full_name once a repository: all queries that found it, sorted; the values of the last hit; when it was seen first and last.

    hits: full_name, query, run (ISO date), seq (order of the hits), and any columns of the answer.
    """
    rest = [c for c in hits.columns if c not in ("full_name", "query", "run", "seq")]
    g = hits.groupBy(F.lower("full_name").alias("key")).agg(
        F.array_join(F.array_sort(F.collect_set("query")), "; ").alias("queries"), F.max(F.struct("seq", "full_name", *rest)).alias("_l"), F.min(F.struct("seq", "full_name")).alias("_f"),
        F.min("run").alias("first_seen"), F.max("run").alias("last_seen"),
    )
    return g.select(F.col("_f.full_name").alias("full_name"), *[F.col(f"_l.{c}").alias(c) for c in rest], "queries", "first_seen", "last_seen")


def gathered(paper_links: DataFrame, local_links: DataFrame) -> DataFrame:
    """repo with the papers and folders that link it, whether a paper calls it its own code, whether a registry names it.

    paper_links: repo, uid, own; local_links: repo, folder, registry. Sets are counted before they are collected into one
    sorted text of the repository.
    """
    rows = paper_links.select("repo", "uid", F.lit(None).cast("string").alias("folder"), "own", F.lit(False).alias("registry"))
    rows = rows.unionByName(local_links.select("repo", F.lit(None).cast(paper_links.schema["uid"].dataType).alias("uid"), "folder", F.lit(False).alias("own"), "registry"))
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), "; ")
    return rows.groupBy("repo").agg(listed("uid").alias("papers"), listed("folder").alias("folders"), F.max("own").alias("own_code"), F.max("registry").alias("registry"))


def releases(files: DataFrame, key: str = "name", day: str = "uploaded") -> DataFrame:
    """First and last day of a package's releases; empty days don't count."""
    d = F.when(S.text(F.col(day)) != "", F.substring(S.text(F.col(day)), 1, 10))
    return files.groupBy(key).agg(F.coalesce(F.min(d), F.lit("")).alias("created"), F.coalesce(F.max(d), F.lit("")).alias("updated"))


def first_month(downloads: DataFrame, key: str = "name") -> DataFrame:
    """The first month with downloads as its first day. downloads: key, year, month (Jan to Dec, other rows are totals), n."""
    months = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
    place = F.array_position(F.array(*[F.lit(m) for m in months]), F.col("month"))
    rows = downloads.filter((place > 0) & (F.col("n") > 0))
    return rows.groupBy(key).agg(F.min(F.format_string("%s-%02d-01", F.col("year").cast("string"), place)).alias("created"))


def remembered(items: DataFrame, cache: DataFrame, today: str, columns: list[str], days: int = RECHECK_DAYS) -> DataFrame:
    """items (name) with the columns of an answer of the last days, `missing` where that said it is gone, `to_fetch` where there is none."""
    fresh = F.when(S.text(F.col("checked_on")) == "", today).otherwise(F.col("checked_on")) >= F.date_format(F.date_sub(F.lit(today).cast("date"), days), "yyyy-MM-dd")
    known = cache.filter(fresh).groupBy(F.lower("name").alias("_key")).agg(F.max(F.struct("checked_on", "created", "reason", *columns)).alias("_c"))
    j = items.join(known, F.lower(items["name"]) == F.col("_key"), "left").drop("_key")
    found, gone = S.text(F.col("_c.created")) != "", S.text(F.col("_c.reason")) == "repository gone"
    use = {c: F.when(found, F.col(f"_c.{c}")) for c in columns}
    return j.withColumns({**use, "missing": F.coalesce(~found & gone, F.lit(False)), "to_fetch": ~F.coalesce(found | gone, F.lit(False))}).drop("_c")


def package_name(url: Column, index: str) -> Column:
    """Name of the package that a link to an index names, or empty."""
    where = {"cran": r"(?:/package=|/packages/)([^/&]+)", "pypi": r"pypi\.org/project/([^/]+)", "zenodo": r"zenodo(?:\.org/(?:records?|deposit)/|\.)(\d+)"}
    return F.regexp_extract(S.text(url), where[index], 1)


# ---------------------------------------------------------------- answers of the services

REPO = "full_name string, html_url string, description string, created_at string, pushed_at string, stargazers_count long, language string, license struct<spdx_id: string>, topics array<string>, archived boolean, fork boolean"


def repositories(answers: DataFrame, keep: list[str] | None = None, column: str = "value") -> DataFrame:
    """Rows of a repository look-up's or a repository search's answers (`items`)."""
    j = F.from_json(F.col(column), f"items array<struct<{REPO}>>, {REPO}")
    one = F.coalesce(F.col("_j.items"), F.array(F.struct(*[F.col(f"_j.{f.split(' ')[0]}").alias(f.split(" ")[0]) for f in split_fields(REPO)])))
    r = F.col("_r")
    rows = answers.withColumn("_j", j).select(*(keep or []), F.explode(one).alias("_r"))
    return rows.select(
        *(keep or []), r["full_name"].alias("full_name"), r["html_url"].alias("url"), F.replace(S.text(r["description"]), F.lit("\n"), F.lit(" ")).alias("description"),
        F.substring(S.text(r["created_at"]), 1, 10).alias("created"), F.substring(S.text(r["pushed_at"]), 1, 10).alias("updated"), F.coalesce(r["stargazers_count"], F.lit(0)).alias("stars"),
        S.text(r["language"]).alias("language"), S.text(r["license"]["spdx_id"]).alias("license"), F.array_join(F.coalesce(r["topics"], F.array().cast("array<string>")), "; ").alias("topics"),
        F.coalesce(r["archived"], F.lit(False)).alias("archived"), F.coalesce(r["fork"], F.lit(False)).alias("fork"),
    ).filter("full_name IS NOT NULL")


def split_fields(schema: str) -> list[str]:
    """Fields of a schema text, without cutting what is nested."""
    out, depth, now = [], 0, ""
    for ch in schema:
        depth += {"<": 1, ">": -1}.get(ch, 0)
        if ch == "," and not depth:
            out.append(now.strip())
            now = ""
        else:
            now += ch
    return [*out, now.strip()]


def index_packages(answers: DataFrame, index: str, column: str = "value") -> DataFrame:
    """name, url, description, license, created, updated of answers of the R archive ('cran') or the Python index ('pypi')."""
    v = F.col(column)
    if index == "cran":
        j = F.from_json(v, "name string, latest string, timeline map<string,string>, versions map<string, struct<Title: string, Description: string, License: string>>")
        last = F.try_element_at(F.col("_j.versions"), F.col("_j.latest"))
        days = F.map_values("_j.timeline")
        parts = (F.col("_j.name"), F.concat(F.lit("https://cran.r-project.org/package="), "_j.name"), F.concat(S.text(last["Title"]), F.lit(". "), S.text(last["Description"])), last["License"], days)
    else:
        j = F.from_json(v, "info struct<name: string, summary: string, license: string>, releases map<string, array<struct<upload_time: string>>>")
        days = F.flatten(F.transform(F.map_values("_j.releases"), lambda x: x["upload_time"]))
        parts = (F.col("_j.info.name"), F.concat(F.lit("https://pypi.org/project/"), "_j.info.name", F.lit("/")), F.col("_j.info.summary"), F.col("_j.info.license"), days)
    name, url, text, terms, days = parts
    day = lambda c: S.text(F.substring(c, 1, 10))
    return answers.withColumn("_j", j).select(name.alias("name"), url.alias("url"), S.text(text).alias("description"), S.text(terms).alias("license"), day(F.array_min(days)).alias("created"), day(F.array_max(days)).alias("updated")).filter("name IS NOT NULL")


BIOC = "map<string, struct<Title: string, Description: string, License: string, git_last_commit_date: string>>"


def bioconductor_packages(answers: DataFrame, first: DataFrame | None = None, column: str = "value") -> DataFrame:
    """name, url, description, license, created, updated of a Bioconductor release's list of packages; created is that of first_month(), by name."""
    rows = answers.select(F.explode(F.from_json(F.col(column), BIOC)).alias("name", "_d"))
    told = S.collapse(F.concat(S.text(F.col("_d.Title")), F.lit(" "), S.text(F.col("_d.Description"))))
    out = rows.select("name", F.concat(F.lit("https://bioconductor.org/packages/"), "name").alias("url"), told.alias("description"), S.text(F.col("_d.License")).alias("license"), F.substring(S.text(F.col("_d.git_last_commit_date")), 1, 10).alias("updated"))
    if first is None:
        return out.withColumn("created", F.lit("")).select("name", "url", "description", "license", "created", "updated")
    return out.join(first.select("name", "created"), "name", "left").select("name", "url", "description", "license", S.text(F.col("created")).alias("created"), "updated")


ARCHIVED = "id string, doi string, created string, updated string, links struct<html: string>, metadata struct<title: string, description: string, publication_date: string, license: struct<id: string>, resource_type: struct<type: string>>"
#: Characters of an archive's description.
DESCRIPTION_MAX = 600


def archive_records(answers: DataFrame, keep: list[str] | None = None, column: str = "value") -> DataFrame:
    """name, url, description, created, updated, doi, license, resource of answers of a data archive; tags in a description are blanks.

    keep are columns of the answers that stay, such as the number and the link that was looked up: the link stands for a
    missing address, `zenodo:` and the number for a missing title.
    """
    keep = keep or []
    j = answers.withColumn("_j", F.from_json(F.col(column), ARCHIVED)).filter("_j IS NOT NULL")
    m, some = F.col("_j.metadata"), lambda c: F.when(S.text(c) != "", c)
    number = F.col("number") if "number" in keep else F.col("_j.id")
    link = F.col("link") if "link" in keep else F.lit("")
    day = lambda c: F.substring(S.text(c), 1, 10)
    return j.select(
        *keep, F.coalesce(m["title"], F.concat(F.lit("zenodo:"), number)).alias("name"), F.coalesce(F.col("_j.links.html"), link).alias("url"),
        F.substring(F.regexp_replace(S.text(m["description"]), "<[^>]+>", " "), 1, DESCRIPTION_MAX).alias("description"), day(F.coalesce(some(F.col("_j.created")), m["publication_date"])).alias("created"),
        day(F.col("_j.updated")).alias("updated"), S.text(F.col("_j.doi")).alias("doi"), S.text(m["license"]["id"]).alias("license"), S.text(m["resource_type"]["type"]).alias("resource"),
    )
