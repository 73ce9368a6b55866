"""A catalogue stored by key, so that a run's merge neither shuffles what is stored nor rewrites what stays as it is.

The table is partitioned by slices of the key's hash and bucketed by the key within them. A merge joins the stored side
as it lies in its buckets; only the new rows are dealt out to them. It reads and rewrites the slices in which something
changes, each replaced as a whole when all of its files are written. Merging the same rows again changes nothing, so a run
that was lost midway is run again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylark.operators.catalogue import merge_catalogue

FLAG = "not matched in the last run"
#: Columns that a merge keeps as they were.
KEPT = ("added_on", "notes", "user_tags")


def slice_of(key: Column, slices: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("slice")), F.lit(slices)).cast("int")


def _mark(columns: list[str], values: dict[str, Column] | None = None) -> Column:
    """Hash of what a merge may change in a row."""
    given = values or {}
    return F.xxhash64(*[given.get(c, F.col(c)) for c in sorted(columns) if c not in (*KEPT, "uid")])


def _laid(df: DataFrame, columns: list[str], slices: int) -> DataFrame:
    return df.select(*columns, _mark(columns).alias("mark"), slice_of(F.col("uid"), slices).alias("slice"))


def create(df: DataFrame, name: str, path: str, slices: int = 64, buckets: int = 64) -> None:
    """df (uid and any columns) as table `name` with its files at path. Slices and buckets should grow with the table."""
    rows = _laid(df, df.columns, slices).repartition(buckets, "uid")
    rows.write.partitionBy("slice").bucketBy(buckets, "uid").sortBy("uid").option("path", path).option("partitionOverwriteMode", "dynamic").option("slices", str(slices)).saveAsTable(name)


def attach(spark: SparkSession, name: str, path: str, schema: str, slices: int = 64, buckets: int = 64) -> None:
    """Name a table that another session has created; schema is that of its rows."""
    spark.sql(f"CREATE TABLE {name} ({schema}, mark BIGINT, slice INT) USING parquet OPTIONS (path '{path}', partitionOverwriteMode 'dynamic', slices '{slices}') PARTITIONED BY (slice) CLUSTERED BY (uid) SORTED BY (uid) INTO {buckets} BUCKETS")
    spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")


def read(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name).drop("mark", "slice")


def _slices(spark: SparkSession, name: str) -> int:
    rows = {r[0]: r[1] for r in spark.sql(f"DESCRIBE FORMATTED {name}").collect()}
    options = dict(x.split("=", 1) for x in rows["Storage Properties"].strip("[]").split(", "))
    return int(options["slices"])


def touched(stored: DataFrame, new: DataFrame, columns: list[str], flag: str = FLAG) -> DataFrame:
    """Slices (slice) in which a complete set of new rows adds, changes, flags or unflags any. Of what is stored only key, mark and status are read."""
    was = stored.select("uid", F.col("mark").alias("_was"), F.col("status").alias("_status"), F.col("slice").alias("_slice"))
    now = new.select("uid", F.col("mark").alias("_now"), "slice")
    both = was.join(now, "uid", "full_outer")
    changed = F.col("_was").isNull() | F.when(F.col("_now").isNull(), ~F.col("_status").eqNullSafe(flag)).otherwise(F.col("_was") != F.col("_now"))
    return both.filter(changed).select(F.coalesce("slice", "_slice").alias("slice")).distinct()


def merge(spark: SparkSession, name: str, new: DataFrame, today: str, complete: bool = True, flag: str = FLAG) -> list[int]:
    """Merge new rows into the table as merge_catalogue() does; gives the slices that were rewritten.

    complete: new is all that a run found, so stored rows that it lacks are flagged. Otherwise it is a part, and what it lacks
    stays as it is.
    """
    stored, slices = spark.table(name), _slices(spark, name)
    columns = [c for c in stored.columns if c not in ("mark", "slice")]
    given = [c for c in columns if c in new.columns and c != "added_on"]
    shaped = new.select(*given, *[F.lit("").cast(stored.schema[c].dataType).alias(c) for c in columns if c not in given])
    shaped = shaped.withColumn("status", F.coalesce("status", F.lit(""))) if "status" in columns else shaped
    laid = _laid(shaped.select(columns), columns, slices)
    found = touched(stored, laid, columns, flag) if complete else laid.select("slice").distinct()
    which = sorted(r[0] for r in found.collect())  # one number a slice
    if which:
        _merged(stored, laid, columns, which, today, complete, flag, slices).write.mode("overwrite").insertInto(name)
        spark.catalog.refreshTable(name)
    return which


def _merged(stored: DataFrame, laid: DataFrame, columns: list[str], which: list[int], today: str, complete: bool, flag: str, slices: int) -> DataFrame:
    inside = F.col("slice").isin(which)
    old, new = stored.filter(inside).select(columns), laid.filter(inside).select([c for c in columns if c != "added_on"])
    out = merge_catalogue(old, new, today, KEPT, flag) if complete else merge_part(old, new, today)
    return _laid(out.select(columns), columns, slices)


def merge_part(old: DataFrame, new: DataFrame, today: str) -> DataFrame:
    """merge_catalogue() where rows that are only in old stay as they are."""
    mine = "\0not in this part"
    return merge_catalogue(old.withColumn("_status", F.col("status")), new, today, (*KEPT, "_status"), mine).withColumn("status", F.when(F.col("status") == mine, F.col("_status")).otherwise(F.col("status"))).drop("_status")
