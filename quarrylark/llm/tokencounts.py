"""Token counts kept by deltas: signed rows update additive totals by source, language and tokenizer version.

A batch of inserts, deletes and revised counts becomes signed rows (-1 takes back what is live for the key and
version, +1 adds the new count) and their sums by group; totals are the sums over committed batches, so no batch reads
the corpus again. A batch writes its files under a folder of its attempt and then creates the marker with the next
number, which fails if that exists. The marker names the batch: one that is sent twice counts once. Where another batch
took the number, the work is done again on top of it, so that batches that run at once are applied one after the other;
an attempt that dies leaves files that no one reads. A batch reads the live rows of its own keys alone: those of the last
snapshot, and the signed rows since then. Every COMPACT commits a snapshot of live rows and totals is written.

Changes: key, op ('insert', 'delete', 'revise'), source, lang, version, n_tokens, and seq where there is such a column. A
delete or a revision needs key and version alone; a revision without source or language keeps the old ones. Defined
results: an insert of a live (key, version) acts as a revision; deletes and revisions of unknown keys do nothing and
insert respectively; a null count is 0; null versions, sources and languages are groups of their own; of several changes
to one (key, version) in a batch the one with the largest seq holds (a null seq is the smallest), at the same seq a delete
before others and then the one with the largest (count, op, source, language), so that repeated rows count once; null
keys and unknown ops are errors; an empty batch is committed and changes nothing. Other columns aren't read.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import configure, materialise, shared_folder

SIGNED = "key long, source string, lang string, version string, n_tokens long, sign int"
LIVE = "key long, source string, lang string, version string, n_tokens long"
TOTALS = "source string, lang string, version string, n_docs long, n_tokens long"
GROUP = ("source", "lang", "version")
#: Commits from one snapshot to the next.
COMPACT = 16


class Rollup:
    def __init__(self, spark: SparkSession, folder: str, compact: int = COMPACT):
        self.spark, self.folder, self.compact = spark, folder, compact
        jvm = spark.sparkContext._jvm
        self.path = jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.fs.mkdirs(self.path(f"{folder}/commits"))

    def _load(self, path: str):
        for _ in range(100):  # a file is there a moment before its content is
            stream = self.fs.open(self.path(path))
            try:
                raw = bytes(stream.readAllBytes())
            finally:
                stream.close()
            if raw:
                return json.loads(raw.decode())
            time.sleep(0.1)
        raise RuntimeError(f"{path} is empty: its writer died; remove it")

    def _create(self, path: str, what) -> bool:
        """False if there is such a file."""
        try:
            out = self.fs.create(self.path(path), False)
        except Exception:
            if self.fs.exists(self.path(path)):
                return False
            raise
        out.write(bytearray(json.dumps(what).encode()))
        out.close()
        return True

    def state(self) -> tuple[int, str | None, list[str], set[str]]:
        """Number of commits, the attempt that wrote the last snapshot, the attempts since, and all batches."""
        n = len(self.fs.listStatus(self.path(f"{self.folder}/commits")))
        since, batches, base = [], set(), None
        for i in range(n - 1, -1, -1):
            got = self._load(f"{self.folder}/commits/{i:010d}")
            batches.add(got["batch"])
            if got["snapshot"]:
                base = got["attempt"]
                batches |= set(self._load(f"{self.folder}/data/{base}/batches"))
                break
            since.insert(0, got["attempt"])
        return n, base, since, batches

    def commits(self) -> set[str]:
        """The batches that are committed."""
        return self.state()[3]

    def _rows(self, part: str, schema: str, attempts: list[str]) -> DataFrame:
        paths = [f"{self.folder}/data/{a}/{part}" for a in attempts]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def live(self, base: str | None, since: list[str], keys: DataFrame | None = None) -> DataFrame:
        """Rows that the signs leave standing, of all keys or of some."""
        rows = self._rows("signed", SIGNED, since)
        if base:
            rows = rows.unionByName(self._rows("live", LIVE, [base]).withColumn("sign", F.lit(1)))
        if keys is not None:
            rows = rows.join(keys, "key", "left_semi")
        return rows.groupBy("key", *GROUP, "n_tokens").agg(F.sum("sign").alias("sign")).filter("sign > 0").drop("sign")

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commit a batch; False if it was committed before."""
        if batch in self.commits():
            return False
        seq = F.col("seq").cast("long") if "seq" in changes.columns else F.lit(None).cast("long")
        fault = F.when(F.col("key").isNull(), F.raise_error(F.lit("a change without a key")))
        fault = fault.when(~F.coalesce(F.col("op"), F.lit("")).isin("insert", "delete", "revise"), F.raise_error(F.concat(F.lit("no such change: "), F.coalesce(F.col("op"), F.lit("null")))))
        c = changes.select(fault.otherwise(F.col("key")).cast("long").alias("key"), "op", "source", "lang", "version", F.coalesce(F.col("n_tokens"), F.lit(0)).cast("long").alias("n_tokens"), seq.alias("seq"))
        last = F.struct("seq", (F.col("op") == "delete").alias("d"), "n_tokens", "op", "source", "lang")
        c = c.groupBy("key", "version").agg(F.max(last).alias("c"))
        while True:
            n, base, since, batches = self.state()
            if batch in batches:
                return False
            attempt = f"{uuid.uuid4().hex}"
            self._write(c, attempt, base, since)
            snapshot = len(since) + 1 >= self.compact
            if snapshot:
                self._snapshot(attempt, base, since, sorted(batches))
            if self._create(f"{self.folder}/commits/{n:010d}", {"batch": batch, "attempt": attempt, "snapshot": snapshot}):
                return True

    def _write(self, c: DataFrame, attempt: str, base: str | None, since: list[str]) -> None:
        old = self.live(base, since, c.select("key").distinct()).select("key", F.col("version").alias("ov"), F.col("source").alias("os"), F.col("lang").alias("ol"), F.col("n_tokens").alias("on"))
        both = c.join(old, (c["key"] == old["key"]) & c["version"].eqNullSafe(old["ov"]), "left").drop(old["key"])
        back = both.filter("`on` IS NOT NULL").select("key", F.col("os").alias("source"), F.col("ol").alias("lang"), "version", F.col("on").alias("n_tokens"), F.lit(-1).alias("sign"))
        kept = lambda x, o: F.when(F.col("c.op") == "revise", F.coalesce(f"c.{x}", o)).otherwise(F.col(f"c.{x}")).alias(x)
        forth = both.filter("c.op <> 'delete'").select("key", kept("source", "os"), kept("lang", "ol"), "version", "c.n_tokens", F.lit(1).alias("sign"))
        where = f"{self.folder}/data/{attempt}"
        back.unionByName(forth).write.option("compression", "zstd").parquet(f"{where}/signed")
        signed = self.spark.read.schema(SIGNED).parquet(f"{where}/signed")
        signed.groupBy(*GROUP).agg(F.sum("sign").cast("long").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).alias("n_tokens")).coalesce(1).write.parquet(f"{where}/totals")

    def _snapshot(self, attempt: str, base: str | None, since: list[str], batches: list[str]) -> None:
        where = f"{self.folder}/data/{attempt}"
        self.live(base, [*since, attempt]).write.option("compression", "zstd").parquet(f"{where}/live")
        self._sums(base, [*since, attempt]).coalesce(1).write.parquet(f"{where}/base_totals")
        self._create(f"{where}/batches", batches)

    def _sums(self, base: str | None, since: list[str]) -> DataFrame:
        rows = self._rows("totals", TOTALS, since)
        if base:
            rows = rows.unionByName(self._rows("base_totals", TOTALS, [base]))
        rows = rows.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return rows.filter("n_docs <> 0 OR n_tokens <> 0")

    def totals(self) -> DataFrame:
        """Groups that still have rows."""
        _, base, since, _ = self.state()
        return self._sums(base, since)


#: Tokenizer versions that SQL can count too: words, and words with marks apart.
WORDS = {"words-1": r"[^ \t\n\x0B\f\r]+", "words-2": r"[^ \t\n\x0B\f\r.,;:!?|*$%#&]+|[.,;:!?|*$%#&]"}


def count_of(text, version: str):
    return F.regexp_count(text, F.lit(WORDS[version])).cast("long")


def changes(counts: DataFrame, op: str, version: str, n: str) -> DataFrame:
    """Changes of one kind from a table of counts (doc_id, source, lang, n)."""
    return counts.select(F.col("doc_id").alias("key"), F.lit(op).alias("op"), "source", "lang", F.lit(version).alias("version"), F.col(n).alias("n_tokens"))


def counted(docs: DataFrame, version: str) -> DataFrame:
    """Inserts: the counts of docs (doc_id, text, source, lang) by one tokenizer version."""
    return changes(docs.withColumn("_n", count_of(F.coalesce("text", F.lit("")), version)), "insert", version, "_n")


def counted_bpe(docs: DataFrame, version: str = "byte_bpe_50k", path: str | None = None) -> DataFrame:
    """Inserts with the counts of the public byte-level vocabulary, which SQL can't express."""
    import pyarrow as pa

    from .common import texts_of
    from .packing import shared_encoder

    configure(docs.sparkSession)

    def run(batches):
        ids = shared_encoder(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("source"), b.column("lang"), pa.array([len(ids(t.decode())) for t in texts_of(b, "text")], pa.int64())], ["key", "source", "lang", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("key"), "source", "lang", "text").mapInArrow(run, "key long, source string, lang string, n_tokens long")
    return rows.select("key", F.lit("insert").alias("op"), "source", "lang", F.lit(version).alias("version"), "n_tokens")


def op3_token_rollup(spark, sf_dir):
    """Totals after four batches over whole tables: all documents under words-1; documents labelled toxic taken down;
    counts of documents with repeated lines revised to distinct lines; the documents left counted anew under words-2.
    The second and third batch are sent again, as after a lost answer, and count once."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    toxic = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("toxic = 1").select("doc_id").distinct()
    # texts are read once and never moved: the batches are made of their counts
    t = F.coalesce("text", F.lit(""))
    lines = F.split(t, "\n")
    counts = docs.select(
        "doc_id", "source", "lang", count_of(t, "words-1").alias("words_1"), count_of(F.array_join(F.array_distinct(lines), "\n"), "words-1").alias("words_1_distinct"),
        count_of(t, "words-2").alias("words_2"), F.size(lines).alias("n_lines"), F.size(F.array_distinct(lines)).alias("distinct_lines"),
    )
    counts = materialise(counts, "counts")
    roll = Rollup(spark, shared_folder(spark, "rollup"))
    roll.apply("2024-01", changes(counts, "insert", "words-1", "words_1"))
    away = toxic.select(F.col("doc_id").alias("key"), F.lit("delete").alias("op"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("lang"), F.lit("words-1").alias("version"), F.lit(None).cast("long").alias("n_tokens"))
    roll.apply("2024-02", away)
    left = counts.join(toxic, "doc_id", "left_anti")
    again = changes(left.filter("distinct_lines < n_lines"), "revise", "words-1", "words_1_distinct")
    roll.apply("2024-03", again)
    roll.apply("2024-02", away)
    roll.apply("2024-03", again)
    roll.apply("2024-04", changes(left, "insert", "words-2", "words_2"))
    return roll.totals().select("source", "lang", F.col("version").alias("tokenizer_version"), "n_docs", "n_tokens")


ORACLES = {
    "op3_token_rollup": r"""
        WITH kept AS (SELECT doc_id, coalesce(text, '') AS text, source, lang FROM documents
                      WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)),
        n AS (SELECT source, lang, 'words-1' AS tokenizer_version,
                     list_sum(list_transform(list_distinct(string_split(text, chr(10))), lambda x: len(regexp_extract_all(x, '[^ \t\n\v\f\r]+')))) AS k FROM kept
              UNION ALL
              SELECT source, lang, 'words-2', len(regexp_extract_all(text, '[^ \t\n\v\f\r.,;:!?|*$%#&]+|[.,;:!?|*$%#&]')) FROM kept)
        SELECT source, lang, tokenizer_version, count(*) AS n_docs, CAST(sum(k) AS BIGINT) AS n_tokens FROM n GROUP BY ALL"""
}
