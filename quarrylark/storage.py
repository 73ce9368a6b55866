"""The folder that the driver and all executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else the one given to ``setCheckpointDir``.

    Where both are unset, a local session gets an own temporary folder, one for each application; on a cluster that would
    be a folder of one machine, so there it is an error.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _own.setdefault(context.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="quarrylark-")
        _own[context.applicationId] = found
    return found.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's name below it."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back; cuts lineage and survives lost executors."""
    spark, where = df.sparkSession, shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(where)
    return spark.read.schema(df.schema).parquet(where)
