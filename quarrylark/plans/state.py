"""Queries of tables and streams that keep a state from run to run, and their SQL twins."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from quarrylark.operators import stored as T
from quarrylark.plans.registry import query, table
from quarrylark.sources import harvest
from quarrylark.sources.io import write_text
from quarrylark.storage import materialise, shared_folder
from quarrylark.streaming import retries

DAYS = ("2024-05-01", "2024-05-02")
STORED = f"""old AS (SELECT doc_id AS uid, lang AS title, '2024-01-01' AS added_on, 'note ' || source AS notes, '' AS status FROM documents WHERE doc_id % 10 < 7),
    one AS (SELECT doc_id AS uid, CASE WHEN doc_id % 20 = 3 THEN source ELSE lang END AS title FROM documents WHERE doc_id % 10 BETWEEN 2 AND 8),
    a AS (SELECT coalesce(one.uid, old.uid) AS uid, CASE WHEN one.uid IS NULL THEN old.title ELSE one.title END AS title, coalesce(added_on, '{DAYS[0]}') AS added_on, coalesce(notes, '') AS notes,
          CASE WHEN one.uid IS NULL THEN 'not matched in the last run' ELSE '' END AS status FROM old FULL JOIN one USING (uid)),
    two AS (SELECT doc_id AS uid, lang AS title FROM documents WHERE doc_id % 10 IN (0, 3, 9)),
    b AS (SELECT coalesce(two.uid, a.uid) AS uid, CASE WHEN two.uid IS NULL THEN a.title ELSE two.title END AS title, coalesce(added_on, '{DAYS[1]}') AS added_on, coalesce(notes, '') AS notes,
          CASE WHEN two.uid IS NULL THEN status ELSE '' END AS status FROM a FULL JOIN two USING (uid))"""


@query("catalogue_merge_stored", f"WITH {STORED} SELECT * FROM b")
def _(spark, sf):
    """A complete run merged into the stored table, then a part of another run; the result is read before the table's name goes."""
    name = "catalogue_" + uuid.uuid4().hex
    d, k = table(spark, sf, "documents"), F.col("doc_id")
    found = lambda where, title: d.filter(where).select(k.alias("uid"), title.alias("title"), F.lit("").alias("notes"), F.lit("").alias("status"))
    old = found(k % 10 < 7, F.col("lang")).select("uid", "title", F.lit("2024-01-01").alias("added_on"), "status").join(d.select(k.alias("uid"), F.concat(F.lit("note "), "source").alias("notes")), "uid")
    T.create(old, name, shared_folder(spark, "stored"), slices=16, buckets=8)
    try:
        T.merge(spark, name, found((k % 10).between(2, 8), F.when(k % 20 == 3, F.col("source")).otherwise(F.col("lang"))), DAYS[0])
        T.merge(spark, name, found((k % 10).isin(0, 3, 9), F.col("lang")), DAYS[1], complete=False)
        return materialise(T.read(spark, name), "merged")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


# ---------------------------------------------------------------- a service by days

#: Days of the three runs, by the share of the span of days that they leave behind.
CLOCKS = "c AS (SELECT min(CAST(ts AS DATE)) AS lo, max(CAST(ts AS DATE)) AS hi FROM events)"


def staged_events(spark, sf):
    """Folder of events as a service's answers: a row is indexed up to nine days after its own day."""
    where = shared_folder(spark, "harvest")
    e = table(spark, sf, "events").withColumn("d", F.to_date("ts"))
    text = F.concat_ws(" ", "event_type", F.lit("by user"), F.col("user_id").cast("string"), F.lit("here"))
    rows = e.select(F.col("event_id").cast("string").alias("id"), F.col("d").cast("string").alias("day"), text.alias("text"), F.col("value").cast("string").alias("value"), F.date_add("d", (F.col("event_id") % 10).cast("int")).cast("string").alias("indexed"))
    rows.write.parquet(f"{where}/rows")
    return where, e.agg(F.min("d"), F.max("d")).first()


@query("harvest_pushed", f"""WITH {CLOCKS} SELECT event_id AS id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events, c WHERE CAST(ts AS DATE) > lo + 3 AND CAST(ts AS DATE) <= lo + 9 AND contains(event_type || ' by user ' || user_id || ' here', 'k by user 1')""")
def _(spark, sf):
    where, (lo, _) = staged_events(spark, sf)
    harvest.register(spark)
    after = lambda n: (lo + dt.timedelta(days=n)).isoformat()
    test = (F.col("day") > after(3)) & (F.col("day") <= after(9)) & F.col("text").contains("k by user 1")
    got = harvest.ask(spark, test, staged=f"{where}/rows", cap="2000", columns="id,day,text")
    return got.select(F.col("id").cast("long").alias("id"), "day")


@query("harvest_runs", f"""WITH {CLOCKS} SELECT event_id AS id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events, c WHERE CAST(ts AS DATE) + CAST(event_id % 10 AS INTEGER) <= hi - 2""")
def _(spark, sf):
    """Three runs of one stream, each on a later day of the service; the offset is Spark's."""
    where, (lo, hi) = staged_events(spark, sf)
    harvest.register(spark)
    span = (hi - lo).days
    for today in (lo + dt.timedelta(days=span // 3), lo + dt.timedelta(days=2 * span // 3), hi - dt.timedelta(days=2)):
        write_text(spark, f"{where}/clock", today.isoformat())
        stream = spark.readStream.format("harvest").options(staged=f"{where}/rows", clock=f"{where}/clock", cap="5000", **{"from": lo.isoformat()}).load()
        run = harvest.once(stream).writeStream.format("parquet").option("checkpointLocation", f"{where}/state").start(f"{where}/found")
        try:
            run.processAllAvailable()
        finally:
            run.stop()
    return spark.read.schema(", ".join(f"{c} string" for c in harvest.COLUMNS)).parquet(f"{where}/found").select(F.col("id").cast("long").alias("id"), "day")


# ---------------------------------------------------------------- what is to be tried again

#: Results of attempts, by event.
RESULTS = ["ok", "partial", "deferred", "none", "none", "removed", "error"]


@query("retry_stream", f"""WITH a AS (SELECT user_id, ts, ['{"', '".join(RESULTS)}'][event_id % 7 + 1] AS status FROM events WHERE event_id % 20 < 6),
    last AS (SELECT user_id, max_by(status, (ts, status)) AS status, max(ts) AS ts FROM a GROUP BY 1), today AS (SELECT CAST(max(ts) AS DATE) AS day FROM a)
    SELECT 'user:' || user_id AS uid, status, status IN ('partial', 'deferred', 'error') OR (status = 'none' AND CAST(ts AS DATE) + 2 < day) AS due FROM last, today""")
def _(spark, sf):
    """Events as attempts, replayed in three batches with timers of two days."""
    where = shared_folder(spark, "retries")
    k = F.col("event_id")
    status = F.element_at(F.array(*[F.lit(s) for s in RESULTS]), (k % 7 + 1).cast("int"))
    a = table(spark, sf, "events").filter(k % 20 < 6).select(F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("uid"), F.col("ts").cast("timestamp").alias("ts"), status.alias("status"))
    lo, hi = a.agg(F.min("ts").cast("timestamp_ntz"), F.max("ts").cast("timestamp_ntz")).first()
    cuts = [lo + (hi - lo) * i / 3 for i in (1, 2)]
    at = F.col("ts").cast("timestamp_ntz")
    for part in (at < F.lit(cuts[0]), (at >= F.lit(cuts[0])) & (at < F.lit(cuts[1])), at >= F.lit(cuts[1])):
        a.filter(part).write.mode("append").parquet(f"{where}/in")
        stream = spark.readStream.schema(a.schema).parquet(f"{where}/in")
        run = retries.transitions(stream, 2).writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{where}/state").start(f"{where}/out")
        try:
            run.processAllAvailable()
        finally:
            run.stop()
    return retries.standing(spark.read.parquet(f"{where}/out"))
