"""Records of one batch resolved against what is stored and against each other.

A record has a uid and keys in order (DOI, PMID, ...); an alias is a key under which a record was found before. Keys meet
through the first record that has them, never pair by pair, so a key that a third of all records share is one row for each
task of the grouping and a split join. Records are named by the first of them in order.

Defined results: null keys are no keys; a record without keys is known by its uid alone; repeated rows are records of
their own, which their uid joins; an empty batch gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylark.operators.components import connected, roots
from quarrylark.operators.ordering import running_number
from quarrylark.storage import materialise


def _keyed(records: DataFrame, order: list) -> tuple[DataFrame, DataFrame]:
    """records with their place _n in order, and (_n, rank, alias) of each key, the uid first."""
    rows = materialise(running_number(records, order, "_n"), "records")
    keys = F.concat(F.array("uid"), F.coalesce("keys", F.array().cast("array<string>")))
    return rows, rows.select("_n", F.posexplode(keys).alias("rank", "alias")).filter("alias IS NOT NULL")


def resolve_linked(records: DataFrame, order: list, aliases: DataFrame | None = None) -> DataFrame:
    """records (uid, keys) with resolved: all that shared keys connect, directly or over others, are one work.

    Its name is the stored record that its first member finds by its first known key, where any member finds one, else
    the first member's uid. Stored records that a batch connects stay two.
    """
    rows, keyed = _keyed(records, order)
    first = keyed.groupBy("alias").agg(F.min("_n").alias("b"))
    groups = connected(keyed.join(first, "alias").filter("_n <> b").select(F.col("_n").alias("a"), "b"))
    placed = rows.select("_n", "uid").join(groups.withColumnRenamed("node", "_n"), "_n", "left").withColumn("component", F.coalesce("component", "_n"))
    placed = materialise(placed, "placed")
    names = placed.filter("_n = component").select("component", F.col("uid").alias("_name"))
    if aliases is not None:
        hits = keyed.join(aliases.select("alias", "target"), "alias").join(placed.select("_n", "component"), "_n")
        stored = hits.groupBy("component").agg(F.min(F.struct("_n", "rank", "target"))["target"].alias("_stored"))
        names = names.join(stored, "component", "left").select("component", F.coalesce("_stored", "_name").alias("_name"))
    found = placed.join(names, "component").select("_n", F.col("_name").alias("resolved"))
    return rows.join(found, "_n").drop("_n")


def resolve_in_order(records: DataFrame, order: list, aliases: DataFrame | None = None) -> DataFrame:
    """records (uid, keys) with resolved, as if they were stored one after another: each goes where its first known key leads.

    A key leads to the stored record that has it, else to the first record of the batch that has it, and with that one to
    where that went. A record whose keys lead to two works joins the first and leaves the other as it is.
    """
    rows, keyed = _keyed(records, order)
    first = keyed.groupBy("alias").agg(F.min("_n").alias("_first"))
    leads = keyed.join(first, "alias")
    if aliases is not None:
        leads = leads.join(aliases.groupBy("alias").agg(F.min("target").alias("target")), "alias", "left")
    else:
        leads = leads.withColumn("target", F.lit(None).cast(records.schema["uid"].dataType))
    leads = leads.filter("target IS NOT NULL OR _first < _n")
    lead = materialise(leads.groupBy("_n").agg(F.min(F.struct("rank", "target", "_first")).alias("to")).select("_n", "to.target", F.when(F.col("to.target").isNull(), F.col("to._first")).alias("parent")), "leads")
    up = roots(lead.filter("parent IS NOT NULL").select(F.col("_n").alias("node"), "parent"))
    ends = rows.select("_n", "uid").join(up.withColumnRenamed("node", "_n"), "_n", "left").select("_n", F.coalesce("root", "_n").alias("root"))
    own = rows.select(F.col("_n").alias("root"), F.col("uid").alias("_uid")).join(lead.filter("target IS NOT NULL").select(F.col("_n").alias("root"), "target"), "root", "left")
    named = ends.join(own.select("root", F.coalesce("target", "_uid").alias("resolved")), "root").select("_n", "resolved")
    return rows.join(named, "_n").drop("_n")


def new_aliases(resolved: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """alias, target of all keys of a resolved batch; a key that is stored keeps its target, one of several works goes to the smallest."""
    keys = F.concat(F.array("uid", "resolved"), F.coalesce("keys", F.array().cast("array<string>")))
    own = resolved.select(F.explode(keys).alias("alias"), F.col("resolved").alias("target")).filter("alias IS NOT NULL").groupBy("alias").agg(F.min("target").alias("target"))
    return own if aliases is None else aliases.select("alias", "target").unionByName(own.join(aliases.select("alias"), "alias", "left_anti"))
