"""Documents to training sequences: quality, exact copies, near copies, packing.

Every stage works on all that the one before it kept; between stages documents are Parquet in the shared folder. Rows are
dropped as rows, never by id, so that a null or repeated id takes no other text with it. All stages pass on any columns,
whatever their names, and give an empty table for an empty one.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from quarrylark.llm import common, dedup, packing, quality, setjoin

#: Documents below this score go: the classifier's own decision, as op4 predicts.
REJECT_BELOW = 0.5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the factorisation machine rejects. Null text is scored as empty; repeated rows have equal scores; ids aren't read."""
    common.configure(spark)
    machine = quality.train(quality.labelled_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    shared = spark.sparkContext.broadcast((machine.w0, machine.w.astype("f4"), machine.v.astype("f4")))

    def run(batches):
        f, m = quality.features(), quality.Machine(*shared.value)
        for b in batches:
            t = common.texts_of(b, "text")
            for s in range(0, len(t), 64):
                scores = m.score([f.of(x) for x in t[s : s + 64]])
                yield b.slice(s, 64).filter(pc.greater_equal(pa.array(scores), REJECT_BELOW))

    return docs.mapInArrow(run, docs.schema)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased, null as empty) one row stays: that with the largest doc_id, of repetitions the last."""
    return dedup.survivors(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that five-word shingle sets of Jaccard 0.8 or more connect, the smallest doc_id stays.

    Of repetitions of that id the first in place stays. Rows without words or without an id are linked with nothing and stay.
    """
    return setjoin.representatives(docs, k=5, share=80)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens: one row for each piece of a document. Null text packs as its closing id, repeated rows each."""
    common.configure(spark)
    return packing.best_fit(packing.pieces(docs)).withColumnRenamed("key", "doc_id")


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("packing", pack_stage)]

#: SQL can't express the classifier or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
