"""Readers and writers of catalogue files. Every CSV column is text and empty means missing."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CSV = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file of any file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(text.encode()))
    out.close()


def rename_parts(spark: SparkSession, folder: str, old: str, new: str) -> None:
    """Files of a folder with another ending."""
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = jvm_path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for s in fs.listStatus(jvm_path(folder)):
        name = s.getPath().toString()
        if name.endswith(old):
            fs.rename(s.getPath(), jvm_path(name[: -len(old)] + new))


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None, sep: str = ",") -> DataFrame:
    """All text; a missing file is an empty table."""
    if not exists(spark, path):
        return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in columns or []]))
    df = spark.read.options(**CSV, sep=sep).csv(path)
    for c in columns or []:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(""))
    return df.na.fill("")


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines, gzip by name; blank lines are skipped. One gzip file is one task: rewrite large ones as Parquet."""
    return spark.read.schema(schema).json(path)


def read_text_lines(spark: SparkSession, folder: str, suffixes: list[str], limit: int | None = None, skip: list[str] | None = None, line_sep: str | None = None) -> DataFrame:
    """file, line of text files below a folder, by suffix, but for folders and files of the names to skip.

    Files of any size are read; a limit, where one is given, leaves out larger ones whole. Lines end at line_sep, else at any of LF, CR LF, CR.
    """
    reader = spark.read.option("recursiveFileLookup", True)
    df = (reader.option("lineSep", line_sep) if line_sep else reader).text(folder).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("value").alias("line"))
    if skip:
        df = df.filter(~F.arrays_overlap(F.split("file", "/"), F.array(*[F.lit(s) for s in skip])))
    if limit is not None:
        df = df.filter(F.col("size") <= limit)
    return df.filter(F.lower(F.regexp_extract("file", r"\.([^./]+)$", 1)).isin(*suffixes)).drop("size")


def uid_list(spark: SparkSession, path: str) -> DataFrame:
    """uid from a CSV with uid or doi, else one uid a line; a byte-order mark is passed over."""
    from quarrylark.functions.scalars import normalise_doi

    first = (spark.read.text(path).limit(1).collect() or [[""]])[0][0].lstrip("\ufeff")
    heads = next(csv.reader([first]), [])
    if "uid" in heads or "doi" in heads:
        df = read_csv(spark, path)
        df = df.toDF(*[c.lstrip("\ufeff") for c in df.columns])
        return df.select("uid").filter("uid <> ''") if "uid" in heads else df.select(normalise_doi(F.col("doi")).alias("d")).filter("d <> ''").select(F.concat(F.lit("doi:"), "d").alias("uid"))
    return spark.read.text(path).select(F.trim(F.regexp_replace("value", "^\ufeff", "")).alias("uid")).filter("uid <> ''")


def csv_text(columns: list[str], rows: Iterable[dict]) -> str:
    """Byte-exact CSV of a small result: minimal quotes, doubled, lines end in CR LF; None is empty, extra keys are left out."""
    out = io.StringIO()
    w = csv.DictWriter(out, columns, extrasaction="ignore", lineterminator="\r\n")
    w.writeheader()
    w.writerows([{c: "" if r.get(c) is None else r.get(c) for c in columns} for r in rows])
    return out.getvalue()


def write_csv(df: DataFrame, path: str) -> None:
    df.na.fill("").write.mode("overwrite").options(header=True, quote='"', escape='"', emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "gzip").json(path)


def stats_json(row: dict) -> str:
    return json.dumps(row, indent=2, ensure_ascii=False)


def markdown_table(columns: list[str], rows: Iterable[Iterable]) -> str:
    """Pipes and line feeds are escaped."""
    cell = lambda x: str("" if x is None else x).replace("|", "\\|").replace("\n", " ")
    lines = [columns, ["---"] * len(columns), *[[cell(x) for x in r] for r in rows]]
    return "\n".join("| " + " | ".join(r) + " |" for r in lines) + "\n"
