"""Look-ups by key: what to ask for, in which pieces, and rows of the answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylark.functions import scalars as S

# Keys of one request, and days after which a preprint without a published version is asked for again.
KEYS_A_REQUEST = 50
RECHECK_DAYS = 30


def requests(keys: DataFrame, key: str = "doi", size: int = KEYS_A_REQUEST) -> DataFrame:
    """request, filter: distinct keys in pieces of at most `size`, joined for one request. Keys that hold what joins them are left out.

    Pieces are made in partitions of a range, so that no task holds all keys.
    """
    k = keys.select(F.lower(key).alias("k")).filter((F.col("k") != "") & ~F.col("k").rlike("[|,]")).distinct()
    k = k.repartitionByRange("k").sortWithinPartitions("k").withColumn("id", F.monotonically_increasing_id())
    piece = F.concat(F.shiftright("id", 33).cast("string"), F.lit("-"), F.floor(F.col("id").bitwiseAND((1 << 33) - 1) / size).cast("string"))
    return k.groupBy(piece.alias("request")).agg(F.concat(F.lit("doi:"), F.array_join(F.array_sort(F.collect_list("k")), "|")).alias("filter"))


WORK = "results array<struct<id: string, doi: string, cited_by_count: long, publication_date: string, open_access: struct<oa_status: string, oa_url: string>>>"


def citations(answers: DataFrame, catalogue: DataFrame, old: DataFrame, today: str, column: str = "value") -> DataFrame:
    """uid, doi, cited_by, publication_date, oa_status, oa_url, openalex_id, checked_on: answers replace what was known."""
    w = answers.select(F.explode(F.from_json(F.col(column), WORK)["results"]).alias("w")).select("w.*")
    by = catalogue.filter(S.text(F.col("doi")) != "").groupBy(F.lower("doi").alias("doi")).agg(F.max("uid").alias("uid"))
    new = w.withColumn("doi", S.normalise_doi(F.col("doi"))).join(by, "doi").groupBy("uid").agg(F.max(F.struct("doi", "cited_by_count", "publication_date", "open_access", "id")).alias("w"))
    new = new.select("uid", "w.doi", F.coalesce("w.cited_by_count", F.lit(0)).alias("cited_by"), S.text(F.col("w.publication_date")).alias("publication_date"), S.text(F.col("w.open_access.oa_status")).alias("oa_status"), S.text(F.col("w.open_access.oa_url")).alias("oa_url"), S.text(F.col("w.id")).alias("openalex_id"), F.lit(today).alias("checked_on"))
    return new.unionByName(old.select(new.columns).join(new.select("uid"), "uid", "left_anti"))


def preprints_due(catalogue: DataFrame, known: DataFrame, today: str, days: int = RECHECK_DAYS) -> DataFrame:
    """preprint_doi of bioRxiv and medRxiv papers that were never asked for, or have no published version and an old answer."""
    d = catalogue.filter(F.col("doi").startswith("10.1101/")).select(F.col("doi").alias("preprint_doi")).distinct()
    settled = known.filter((S.text(F.col("published_doi")) != "") | (F.col("checked_on") >= F.date_format(F.date_sub(F.lit(today).cast("date"), days), "yyyy-MM-dd")))
    return d.join(settled.select("preprint_doi"), "preprint_doi", "left_anti")


def published(answers: DataFrame, today: str) -> DataFrame:
    """preprint_doi, server, published_doi, checked_on of answers (preprint_doi, server, value): the first server that knows it,
    and of its versions the last that names a published paper."""
    coll = F.from_json("value", "collection array<struct<published: string>>")["collection"]
    named = F.filter(coll, lambda c: ~S.text(c["published"]).isin("", "NA"))
    rows = answers.select("preprint_doi", "server", coll.alias("c"), S.normalise_doi(F.try_element_at(named, F.lit(-1))["published"]).alias("published_doi")).filter(F.size("c") > 0)
    first = F.min(F.struct((F.col("server") != "biorxiv").alias("late"), "server", "published_doi")).alias("f")
    found = rows.groupBy("preprint_doi").agg(first).select("preprint_doi", "f.server", "f.published_doi")
    asked = answers.select("preprint_doi").distinct()
    return asked.join(found, "preprint_doi", "left").select("preprint_doi", S.text(F.col("server")).alias("server"), S.text(F.col("published_doi")).alias("published_doi"), F.lit(today).alias("checked_on"))


def latest_listing(keys: DataFrame) -> DataFrame:
    """pmcid, version, name, bytes of the files of each article's latest version that has its JSON. keys: key, size.

    Keys are `<pmcid>.<version>/<name>` as object stores list them.
    """
    path = r"^(PMC\d+)\.(\d+)/(.+)$"
    part = lambda i: F.regexp_extract("key", path, i)
    rows = keys.filter(F.col("key").rlike(path)).select(part(1).alias("pmcid"), part(2).cast("int").alias("version"), part(3).alias("name"), F.coalesce(F.col("size").cast("long"), F.lit(-1)).alias("bytes"))
    whole = rows.filter(F.col("name") == F.concat_ws(".", "pmcid", F.col("version").cast("string"), F.lit("json")))
    last = whole.groupBy("pmcid").agg(F.max("version").alias("version"))
    return rows.join(last, ["pmcid", "version"])


def is_attachment(pmcid: Column, version: Column, name: Column) -> Column:
    """A file of a listing that isn't the article's own XML, text, PDF or JSON."""
    return ~name.startswith(F.concat_ws(".", pmcid, version.cast("string"), F.lit(""))) & ~name.contains("/")


def first_archived(answers: DataFrame, column: str = "value") -> DataFrame:
    """url and first_archived (ISO date or empty) of a web archive's answers: JSON rows under a head row."""
    rows = F.from_json(F.col(column), "array<array<string>>")
    stamp = F.try_element_at(F.try_element_at(rows, F.lit(2)), F.lit(1))
    return answers.select("url", F.coalesce(F.concat_ws("-", F.substring(stamp, 1, 4), F.substring(stamp, 5, 2), F.when(stamp.isNotNull(), F.substring(stamp, 7, 2))), F.lit("")).alias("first_archived"))
