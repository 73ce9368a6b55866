"""Catalogue snapshots: a run writes a new folder and then moves the pointer, so that no run reads what it overwrites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylark.operators.catalogue import union_priority
from quarrylark.sources.io import exists


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def current(spark: SparkSession, root: str) -> int:
    """Number of the snapshot in force; 0 if there is none."""
    return max((int(r.value) for r in spark.read.text(f"{root}/pointers").collect()), default=0) if exists(spark, f"{root}/pointers") else 0


def read(spark: SparkSession, root: str) -> DataFrame | None:
    n = current(spark, root)
    return spark.read.parquet(f"{root}/snapshot={n}") if n else None


def commit(df: DataFrame, root: str, expected: int) -> int:
    """df as the snapshot after `expected`; an error if another run was first. A folder that a lost run left is written over."""
    spark, n = df.sparkSession, expected + 1
    if (now := current(spark, root)) != expected:
        raise RuntimeError(f"snapshot {now} is in force, not {expected}")
    df.write.mode("overwrite").parquet(f"{root}/snapshot={n}")
    fs, path = _fs(spark, f"{root}/pointers/{n:012d}.txt")
    out = fs.create(path, False)  # fails if another run has made it meanwhile
    out.write(bytearray(str(n).encode()))
    out.close()
    return n


def piece(df: DataFrame, root: str, name: str) -> bool:
    """Write a piece of a long run once: False where it is done already. A lost run's half-written piece is written over."""
    if exists(df.sparkSession, f"{root}/{name}/_SUCCESS"):
        return False
    df.write.mode("overwrite").parquet(f"{root}/{name}")
    return True


def pieces(spark: SparkSession, root: str, schema) -> DataFrame:
    """All pieces that are done."""
    fs, path = _fs(spark, root)
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    done = [f"{root}/{n}" for n in sorted(names) if exists(spark, f"{root}/{n}/_SUCCESS")]
    return spark.read.schema(schema).parquet(*done) if done else spark.createDataFrame([], schema)


def day_changes(before: DataFrame | None, added: DataFrame) -> DataFrame:
    """Additions of a day: those of later passes replace equal uids of earlier ones."""
    return added if before is None else union_priority([before, added])


def run_row(final: DataFrame, today: str, window_end: str, flag: str = "not matched in the last run") -> DataFrame:
    """One row of totals of a build."""
    return final.agg(F.lit(today).alias("run_date"), F.lit(window_end).alias("window_end"), F.count(F.lit(1)).alias("rows_total"), F.count_if(F.col("added_on") == today).alias("rows_added"), F.count_if(F.col("status") == flag).alias("rows_kept_unmatched"))
