"""The stream of attempts against the batch rule, replayed in three batches."""

import datetime as dt
import random

from pyspark.sql import functions as F

from quarrylark.operators import scope as U
from quarrylark.streaming import retries as R

KIND = "uid string, ts timestamp, status string"
START = dt.datetime(2024, 1, 1, 8, 30)
STATUSES = ["ok", "partial", "deferred", "none", "none", "none", "removed", "error", None]


def run(spark, batches, where, days=30):
    """Transitions of attempts that come file by file."""
    for b in batches:
        spark.createDataFrame(b, KIND).coalesce(1).write.mode("append").parquet(f"{where}/in")
    stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(f"{where}/in")
    q = R.transitions(stream, days).writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{where}/state").start(f"{where}/out")
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.read.parquet(f"{where}/out")


def test_replay_is_the_batch_rule(spark, tmp_path):
    rnd = random.Random(8)
    rows = sorted((START + dt.timedelta(hours=rnd.randrange(24 * 60)), f"u{rnd.randrange(40)}", rnd.choice(STATUSES)) for _ in range(200))
    rows = [(u, t, s) for t, u, s in rows]
    found = run(spark, [rows[:70], rows[70:140], rows[140:]], str(tmp_path), days=12)
    got = {r.uid: (r.status, r.due) for r in R.standing(found).collect()}
    last = {}
    for u, t, s in rows:
        last[u] = max(last.get(u, (t, s or "")), (t, s or ""))
    today = max(t for _, t, _ in rows).date().isoformat()
    df = spark.createDataFrame([(u, s, t.date().isoformat()) for u, (t, s) in last.items()], "uid string, status string, checked string")
    want = {r.uid: (r.status, r.due) for r in df.select("uid", "status", U.again(F.col("status"), F.col("checked"), today, 12).alias("due")).collect()}
    assert got == want and {s for s, d in want.values() if s == "none" and d} and any(s == "none" and not d for s, d in want.values())


def test_timers(spark, tmp_path):
    at = lambda d, h=0: START + dt.timedelta(days=d, hours=h)
    one = [("waits", at(0), "none"), ("again", at(0), "none"), ("gone", at(0), "none"), ("twice", at(0, 1), "none"), ("twice", at(0), "ok"), (None, at(0), "none"), ("no time", None, "none")]
    two = [("again", at(20), "none"), ("gone", at(20), "removed"), ("twice", at(10), "error"), ("old", at(20), "ok")]
    three = [("clock", at(40), "ok")]
    rows = run(spark, [one, two, three], str(tmp_path)).collect()
    got = sorted((r.uid, r.at.date().isoformat(), r.status, r.due) for r in rows)
    assert got == [
        ("again", "2024-01-01", "none", False), ("again", "2024-01-21", "none", False), ("clock", "2024-02-10", "ok", False), ("gone", "2024-01-01", "none", False), ("gone", "2024-01-21", "removed", False),
        ("old", "2024-01-21", "ok", False), ("twice", "2024-01-01", "none", False), ("twice", "2024-01-11", "error", True), ("waits", "2024-01-01", "none", False), ("waits", "2024-02-01", "none", True),
    ]
