"""Texts kept apart from the catalogue: written by buckets of their key, and read late, only where earlier conditions left something."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylark.sources.io import write_text
from quarrylark.storage import materialise

#: Up to so many surviving keys are handed to the scan one by one; beyond, the scan gets their buckets.
FEW = 1000


def bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def write_texts(texts: DataFrame, path: str, key: str = "uid", buckets: int = 64) -> None:
    """texts (key and any columns) by buckets of the key, each sorted by key and with a bloom filter, so that files and row groups can be passed over.

    A bucket that is much larger than others is split over tasks. Buckets should grow with the table: one for each 128 MB or so.
    """
    spark = texts.sparkSession
    rows = texts.withColumn("bucket", bucket(F.col(key), buckets)).hint("rebalance", "bucket").sortWithinPartitions("bucket", key)
    rows.write.partitionBy("bucket").option("compression", "zstd").option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(f"{path}/rows")
    write_text(spark, f"{path}/buckets", str(buckets))


def read_texts(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    return spark.read.parquet(f"{path}/rows"), int(spark.read.text(f"{path}/buckets").first()[0])


def join_late(rows: DataFrame, path: str, key: str = "uid", few: int = FEW) -> DataFrame:
    """rows joined with the texts of their keys; rows without a text are left out.

    The rows, whose conditions are cheap, are settled first. What is left names the buckets that the scan of the texts
    opens, one number a bucket, and where it is few keys the keys themselves, which the scan checks against the sorted
    row groups and their bloom filters. Both only pass over texts that the join would drop.
    """
    texts, buckets = read_texts(rows.sparkSession, path)
    kept = materialise(rows.withColumn("bucket", bucket(F.col(key), buckets)), "survivors")
    n, left = kept.agg(F.count(F.lit(1)), F.collect_set("bucket")).first()
    if n <= few:
        keys = [r[0] for r in kept.select(key).distinct().collect() if r[0] is not None]
        texts = texts.filter(F.col(key).isin(keys))
    if len(left) < buckets:
        texts = texts.filter(F.col("bucket").isin(sorted(left)))
    return kept.join(texts, ["bucket", key]).drop("bucket")
