"""From records, hits, seeds and indexes to catalogue rows.

The many sides are reduced to a row a key before they are joined, so that every join is one to one or many to one and no
row of a record is repeated. Lists that are collected are bounded by a vocabulary (groups, scopes, sources, roles) or by
one document (its links).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylark.functions import scalars as S
from quarrylark.operators import catalogue as C

def names(c: Column) -> Column:
    """Sorted distinct names as one text."""
    return F.array_join(F.array_sort(F.array_distinct(c)), "; ")


def hit_groups(hits: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """uid with its groups, scopes and sources; a hit of an alias counts for the record that has the alias."""
    if aliases is not None:
        known = aliases.groupBy(F.col("alias").alias("uid")).agg(F.min("target").alias("_t"))
        hits = hits.join(known, "uid", "left").withColumn("uid", F.coalesce("_t", "uid")).drop("_t")
    return hits.groupBy("uid").agg(*[F.array_sort(F.collect_set(c)).alias(f"{c}s") for c in ("group", "scope", "source")])


def seed_rollup(seeds: DataFrame) -> DataFrame:
    """doi with its roles, its references (repository:role) and registry ids grouped by repository."""
    repo = seeds.groupBy("doi", "source_repo").agg(F.collect_set("role").alias("r"), F.array_sort(F.collect_set(F.when(S.text(F.col("registry_id")) != "", F.col("registry_id")))).alias("ids"))
    part = F.struct("source_repo", F.concat("source_repo", F.lit(" registry: "), F.array_join("ids", ", ")).alias("t"))
    g = repo.groupBy("doi").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("r")))).alias("roles"),
        names(F.flatten(F.collect_list(F.transform("r", lambda x: F.concat("source_repo", F.lit(":"), x))))).alias("refs"),
        F.array_sort(F.collect_list(F.when(F.size("ids") > 0, part))).alias("p"),
    )
    return g.withColumn("registry_ids", F.array_join(F.transform("p", lambda x: x["t"]), "; ")).drop("p")


def link_list(links: DataFrame, seq: str = "pos") -> DataFrame:
    """uid with the distinct links of its text in order of first sight."""
    first = links.groupBy("uid", "url").agg(F.min(seq).alias("s"))
    return first.groupBy("uid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", "url"))), lambda x: x["url"]), "; ").alias("code_links"))


def related_versions(pairs: DataFrame, seq: str) -> DataFrame:
    """doi and what it's related to, both ways of (preprint_doi, published_doi); of several pairs the last holds."""
    p = pairs.filter(S.text(F.col("published_doi")) != "")
    both = p.select(F.col("preprint_doi").alias("doi"), F.concat(F.lit("published as "), "published_doi").alias("related"), seq).unionByName(p.select(F.col("published_doi").alias("doi"), F.concat(F.lit("preprint "), "preprint_doi").alias("related"), seq))
    return both.groupBy("doi").agg(F.max(F.struct(seq, "related"))["related"].alias("related"))


def attachment_summaries(attachments: DataFrame) -> DataFrame:
    """uid with ok/total and counts by extension of its named files."""
    e = attachments.filter(S.text(F.col("file")) != "").groupBy("uid", F.lower(S.text(F.col("ext"))).alias("ext")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "ok").alias("k"))
    g = e.groupBy("uid").agg(F.sum("k").alias("ok"), F.sum("n").alias("total"), F.collect_list(F.struct("ext", "n")).alias("x"))
    return g.select("uid", S.attachment_summary(F.col("ok"), F.col("total"), F.col("x")).alias("attachments"))


def resolve_cascade(open_keys: DataFrame, sources: list[tuple[str, DataFrame]], key: str = "doi") -> DataFrame:
    """open_keys with resolved_via and uid of the first source that has the key; each source sees only what is still open."""
    left, done = open_keys.select(key).distinct(), []
    for name, source in sources:
        found = left.join(source.groupBy(key).agg(F.min("uid").alias("uid")), key)
        done.append(found.withColumn("resolved_via", F.lit(name)))
        left = left.join(found, key, "left_anti")
    done.append(left.withColumn("uid", F.lit("")).withColumn("resolved_via", F.lit("")))
    return reduce(DataFrame.unionByName, done)


def with_references(catalogue: DataFrame, records: DataFrame, columns=("authors", "venue", "volume", "issue", "pages")) -> DataFrame:
    """Catalogue rows with the record's full fields, and the row's own where there is no record."""
    r = records.select("uid", F.lit(True).alias("_r"), *[F.col(c).alias(f"_{c}") for c in columns])
    j = catalogue.join(r, "uid", "left")
    own = {c: S.text(F.col(c)) if c in catalogue.columns else F.lit("") for c in columns}
    return j.withColumns({c: F.when(F.col("_r"), S.text(F.col(f"_{c}"))).otherwise(own[c]) for c in columns}).drop("_r", *[f"_{c}" for c in columns])


def catalogue_rows(records: DataFrame, hits: DataFrame, seeds: DataFrame, rules: dict, start: str, end: str, *, fulltext=None, attachments=None, links=None, citations=None, pairs=None, aliases=None) -> DataFrame:
    """Every record with its classes, joins, tier and route.

    rules: category (list), default, modality, species, entities (name to pattern), core_title (pattern), core_categories,
    landmark_roles, venues (prefix to name). A table that isn't given counts as empty. seeds, citations and pairs are joined as
    the optimiser's size estimate says; nothing is broadcast by hand.
    """
    c = F.col
    text = F.concat_ws(" ", *[S.text(c(f)) for f in ("title", "abstract", "keywords", "mesh")])
    df = records.join(hit_groups(hits, aliases), "uid", "left").join(seed_rollup(seeds), "doi", "left")
    df = df.join(attachment_summaries(attachments), "uid", "left") if attachments is not None else df.withColumn("attachments", F.lit(""))
    df = df.join(link_list(links), "uid", "left") if links is not None else df.withColumn("code_links", F.lit(""))
    df = df.join(related_versions(pairs, "seq"), "doi", "left") if pairs is not None else df.withColumn("related", F.lit(None).cast("string"))
    if citations is not None:
        df = df.join(citations.select("uid", S.integer(c("cited_by")).alias("_cites"), c("publication_date").alias("_day")), "uid", "left")
    else:
        df = df.withColumns({"_cites": F.lit(0), "_day": F.lit("")})
    if fulltext is not None:
        df = df.join(fulltext.select("uid", c("status").alias("fulltext_status"), c("folder").alias("_folder"), c("license").alias("_license"), c("has_md").alias("_md"), F.lit(True).alias("_tried")), "uid", "left")
    else:
        df = df.withColumns({"fulltext_status": F.lit(""), "_folder": F.lit(""), "_license": F.lit(""), "_md": F.lit(""), "_tried": F.lit(None).cast("boolean")})
    roles = F.coalesce(c("roles"), F.array().cast("array<string>"))
    scopes = F.coalesce(c("scopes"), F.array().cast("array<string>"))
    seed = c("roles").isNotNull()
    df = df.withColumn("category", C.category(rules.get("category", []), c("pub_types"), c("title"), text, rules.get("default", "application/association"), F.array_contains(roles, "registry_origin")))
    core = c("category").isin(*rules.get("core_categories", ["method development", "benchmark/comparison", "review", "software/resource"]))
    core_title = c("title").rlike(C.valid_regex(rules["core_title"])) if rules.get("core_title") else F.lit(False)
    landmark = F.arrays_overlap(roles, F.array(*[F.lit(x) for x in rules.get("landmark_roles", [])]).cast("array<string>"))
    species = C.all_matches(text, rules.get("species", {}), "human" if "human" in rules.get("species", {}) else "", S.text(c("mesh")).contains("Humans"))
    date = S.sharpen(S.best_date(c("pub_date"), c("pub_year")), c("_day"))
    tier = C.tier_of(landmark, F.array_contains(scopes, "focused"), core_title, core, seed)
    out = df.select(
        "uid", date.alias("date"), F.substring(date, 1, 4).alias("year"), S.resource_type(c("is_preprint"), c("category"), c("pub_types"), c("source_db")).alias("resource_type"),
        tier.alias("tier"), "category", F.array_join(C.all_matches(text, rules.get("modality", {})), "; ").alias("modality"), F.array_join(species, "; ").alias("species"),
        F.concat_ws("; ", F.when(S.text(c("registry_ids")) != "", c("registry_ids")), F.array_join(C.entities(text, rules.get("entities", {})), "; ")).alias("entities"),
        S.text(c("title")).alias("title"), S.first_authors(c("authors")).alias("authors"), S.venue(c("journal"), rules.get("venues", {})).alias("venue"), S.text(c("doi")).alias("doi"),
        S.landing_url(c("doi"), c("pmid"), c("url")).alias("url"), S.text(c("code_links")).alias("code_links"),
        F.coalesce(c("related"), F.when(S.text(c("related_doi")) != "", F.concat(F.lit("published as "), c("related_doi"))), F.lit("")).alias("related"),
        F.when(F.coalesce(c("is_open_access"), F.lit(False)) | S.text(c("fulltext_status")).isin("ok", "partial"), "yes").when(c("_tried"), "no").otherwise("unknown").alias("open_access"),
        F.when(S.text(c("_license")) != "", c("_license")).otherwise(S.text(c("license"))).alias("license"), S.text(c("fulltext_status")).alias("fulltext_status"),
        F.when((S.text(c("_folder")) != "") & (S.text(c("_md")) == "True"), F.concat("_folder", F.lit("/paper.md"))).otherwise("").alias("fulltext_md"),
        S.text(c("attachments")).alias("attachments"), F.greatest(S.integer(c("cited_by")), F.coalesce(c("_cites"), F.lit(0))).alias("cited_by"),
        F.array_join(F.coalesce(c("groups"), F.array().cast("array<string>")), "; ").alias("matched_groups"),
        names(F.concat(F.coalesce(c("sources"), F.array().cast("array<string>")), F.when(seed, F.array(F.lit("local seed"))).otherwise(F.array().cast("array<string>")))).alias("found_by"),
        S.text(c("refs")).alias("local_refs"), F.when(date == "", "undated").otherwise("").alias("status"), scopes.alias("_scopes"), seed.alias("_seed"),
    )
    inside = (c("date") == "") | c("date").between(start, end)
    where = F.when((c("tier") != "") & inside, "catalogue").when(c("tier") != "", "before_window").when(c("_seed"), "off_topic_seed").when(F.array_contains("_scopes", "broad"), "broad").otherwise("dropped")
    return out.withColumn("route", where).drop("_scopes", "_seed")
