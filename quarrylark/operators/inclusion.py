"""Which repositories and websites enter the catalogue, and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylark.functions import scalars as S

# Kinds whose rows come from a package index; stars from which code isn't taken for a paper's own.
INDEXES = ["cran", "bioconductor", "pypi", "zenodo"]
OWN_CODE_BELOW = 500
# HTTP answers of a site that is there but refuses programs.
REFUSALS = [401, 403, 429]


def linked_papers(links: DataFrame, catalogue: DataFrame) -> DataFrame:
    """repo with its papers in the catalogue: uids and dois in order, whether any is landmark or core, whether any calls the code its own."""
    j = links.join(catalogue.select("uid", "tier", "doi"), "uid")
    one = j.groupBy("repo", "uid").agg(F.first("tier").alias("tier"), F.first("doi").alias("doi"), F.max("own").alias("own"))
    g = one.groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("uid", "doi"))).alias("p"), F.max(F.col("tier").isin("landmark", "core")).alias("core_papers"), F.max("own").alias("own_code"))
    return g.select("repo", F.array_join(F.transform("p", lambda x: x["uid"]), "; ").alias("papers"), F.array_join(F.slice(F.filter(F.transform("p", lambda x: x["doi"]), lambda d: S.text(d) != ""), 1, 20), "; ").alias("related"), "core_papers", "own_code")


def repository_reason(*, gone: Column, fork: Column, papers: Column, relevant: Column, own_code: Column, core_papers: Column, stars: Column, local: Column, registry: Column, kind: Column, min_stars: int = 3) -> Column:
    """struct(included, reason); the first reason that holds."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    out = lambda inc, why: F.struct(F.lit(inc).alias("included"), F.lit(why).alias("reason"))
    own = yes(own_code) & (S.integer(stars) < OWN_CODE_BELOW) & yes(core_papers)
    return (
        F.when(yes(gone), out(False, "repository gone"))
        .when(yes(fork), out(False, "fork"))
        .when(yes(papers) & (yes(relevant) | own), out(True, "linked from catalogued paper"))
        .when(yes(local) & (yes(relevant) | yes(registry)), out(True, "linked from local project"))
        .when(kind.isin(INDEXES), out(True, "package index match"))
        .when(yes(relevant) & (S.integer(stars) >= min_stars), out(True, f"relevant search hit, >= {min_stars} stars"))
        .otherwise(out(False, "search hit below inclusion bar"))
    )


def repository_tier(core_papers: Column, local: Column, stars: Column, kind: Column) -> Column:
    return F.when(F.coalesce(core_papers, F.lit(False)) | F.coalesce(local, F.lit(False)) | (S.integer(stars) >= 20) | kind.isin("cran", "bioconductor", "pypi"), "core").otherwise("related")


def details(stars: Column, language: Column, updated: Column, archived: Column) -> Column:
    """key=value list of what is known."""
    pair = lambda n, c: F.when(S.text(c) != "", F.concat(F.lit(f"{n}="), S.text(c)))
    return F.concat_ws("; ", pair("stars", stars), pair("language", language), pair("last_update", updated), F.when(F.coalesce(archived, F.lit(False)), "archived"))


def candidates_to_check(candidates: DataFrame, previous: DataFrame, cutoff: str, min_papers: int = 3) -> DataFrame:
    """Sites named by enough papers, with the answer of a check since the cutoff, and to_fetch where there is none."""
    home = F.concat(F.lit("https://"), F.col("domain"), F.lit("/"))
    old = previous.groupBy("url").agg(F.max(F.struct("checked_on", "status", "page_title", "page_description")).alias("o"))
    j = candidates.filter(F.col("n_papers") >= min_papers).withColumn("url", home).join(old, "url", "left")
    fresh = S.text(F.col("o.checked_on")) >= cutoff
    return j.select("domain", "url", "n_papers", (~fresh).alias("to_fetch"), *[F.when(fresh, F.col(f"o.{c}")).alias(c) for c in ("status", "page_title", "page_description")])


def site_inclusion(curated: Column, status: Column, relevant: Column, first_archived: Column, url: Column) -> Column:
    """struct(included, link, availability): an answering site if curated or on the subject, a curated one that refuses programs, and a curated one that is gone but archived."""
    archived = S.text(first_archived) != ""
    out = lambda inc, link, why: F.struct(F.coalesce(inc, F.lit(False)).alias("included"), link.alias("link"), why.alias("availability"))
    copy = F.concat(F.lit("https://web.archive.org/web/"), F.replace(S.text(first_archived), F.lit("-"), F.lit("")), F.lit("/"), url)
    refused = F.concat(F.lit("site refuses automated requests (HTTP "), status.cast("string"), F.lit("); open in a browser"))
    return (
        F.when(status == 200, out(curated | relevant, url, F.lit("")))
        .when(curated & status.isin(REFUSALS), out(F.lit(True), url, refused))
        .when(curated & archived, out(F.lit(True), copy, F.lit("offline; link points to the earliest Internet Archive copy")))
        .otherwise(out(F.lit(False), url, F.lit("")))
    )
