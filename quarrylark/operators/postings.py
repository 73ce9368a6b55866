"""An inverted index for words over long texts: which rows hold all of some words, without reading the texts.

A row's terms are its text's runs between white space, in lower case. A search word, which has no white space, occurs in
the text exactly if it occurs in one of its terms, so the dictionary of terms is searched for words as parts, and only the
postings of terms that hold one are read. Postings of a term lie in blocks of 2^BITS keys, sorted; a block is a row, so a
term that every row has is many short rows. Blocks that lack any of the words are passed over before a posting is opened;
the rest is intersected key by key.

Defined results: null texts have no terms; keys are integers and rows without one aren't indexed; repeated keys are one; no words
find every indexed row that has any term.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylark.operators.texts import join_late, write_texts

BITS = 13


def terms_of(text: Column) -> Column:
    return F.filter(F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+")), lambda t: t != "")


def build(df: DataFrame, path: str, key: str, columns: list[str], buckets: int = 64) -> None:
    """Index of the joined text columns of df at path: postings by buckets of their term, and the dictionary, sorted."""
    text = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in columns])
    each = df.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k"), F.explode(terms_of(text)).alias("term"))
    low = F.col("k").bitwiseAND((1 << BITS) - 1).cast("smallint")
    blocks = each.groupBy("term", F.shiftright("k", BITS).alias("block")).agg(F.array_sort(F.collect_set(low)).alias("places"))  # a block's places are bounded
    write_texts(blocks, f"{path}/postings", key="term", buckets=buckets)
    stored = df.sparkSession.read.parquet(f"{path}/postings/rows")
    stored.groupBy("term").agg(F.count(F.lit(1)).alias("blocks")).orderBy("term").write.option("compression", "zstd").parquet(f"{path}/terms")


def matching(spark: SparkSession, path: str, words: list[str]) -> DataFrame:
    """word (number), term: terms of the dictionary that hold a word."""
    terms = spark.read.parquet(f"{path}/terms").select("term")
    parts = [terms.filter(F.contains("term", F.lit(w))).select(F.lit(i).alias("word"), "term") for i, w in enumerate(words)]
    return reduce(DataFrame.unionByName, parts)


def search(spark: SparkSession, path: str, words: str, key: str = "key") -> DataFrame:
    """Keys of the rows whose text holds all words, as parts of it and in any case."""
    wanted = sorted({w for w in words.lower().split() if w}) or [""]
    hits = join_late(matching(spark, path, wanted), f"{path}/postings", "term")
    full = hits.groupBy("block").agg(F.count_distinct("word").alias("n")).filter(F.col("n") == len(wanted)).select("block")
    each = hits.join(full, "block", "left_semi").select("word", "block", F.explode("places").alias("place"))
    found = each.groupBy("block", "place").agg(F.count_distinct("word").alias("n")).filter(F.col("n") == len(wanted))
    return found.select((F.shiftleft("block", BITS) + F.col("place")).alias(key))
