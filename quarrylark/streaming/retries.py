"""What is to be tried again, as keyed state of a stream of attempts.

Each key keeps its last attempt. An attempt that ended in part, in an error or put off makes the key due at once; one that
found no copy sets the key's timer, and the key is due on the first day that is more than `days` after it; what is there or
was removed is never due, and its timer goes. The batch form of the rule is `operators.scope.again`.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Results of an attempt that are tried again at once, and the one that waits.
AT_ONCE, WAITS = ["partial", "deferred", "error", ""], "none"
FOUND = "uid string, at timestamp, status string, due boolean"


def _expiry(at: dt.datetime, days: int) -> dt.datetime:
    """Midnight of the first day that is more than `days` after the attempt's."""
    return dt.datetime.combine(at.date(), dt.time()) + dt.timedelta(days=days + 1)


def _millis(at: dt.datetime) -> int:
    return int(at.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)


def transitions(attempts: DataFrame, days: int = 30, late: str = "0 seconds") -> DataFrame:
    """uid, at, status, due of a stream of attempts (uid, ts, status): a row when an attempt settles whether its key is due, and one when
    a timer makes it due. Times are UTC.

    Attempts older than the key's last one, or later than the watermark, change nothing; of equal times the larger status counts.
    A null status is empty, a null uid or time no attempt. A key's rows are read as a stream, and only the last is held.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        def row(at: dt.datetime, status: str, due: bool) -> pd.DataFrame:
            return pd.DataFrame({"uid": [key[0]], "at": pd.to_datetime([at]), "status": [status], "due": [due]})

        if state.hasTimedOut:
            at, status = state.get
            state.update((at, status))  # without a timer: due until the next attempt
            yield row(_expiry(at, days), status, True)
            return
        last = tuple(state.get) if state.exists else None
        now = last
        for b in batches:
            for at, status in zip((t.to_pydatetime() for t in b["ts"]), b["status"], strict=True):
                now = max(x for x in (now, (at, status)) if x is not None)
        if now == last:
            return
        at, status = now
        state.update(now)
        due = status in AT_ONCE
        if status == WAITS:
            end = _millis(_expiry(at, days))
            if end > state.getCurrentWatermarkMs():
                state.setTimeoutTimestamp(end)
            else:
                at, due = _expiry(at, days), True
        yield row(at, status, due)

    # times stay plain UTC numbers on the way, so that no session's zone moves them
    known = attempts.filter("uid IS NOT NULL AND ts IS NOT NULL").select(F.col("uid").cast("string").alias("uid"), F.col("ts").cast("timestamp").alias("seen"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.coalesce("status", F.lit("")).alias("status"))
    kept = "at timestamp_ntz, status string"
    out = FOUND.replace("timestamp", "timestamp_ntz")
    return known.withWatermark("seen", late).groupBy("uid").applyInPandasWithState(step, out, kept, "append", GroupStateTimeout.EventTimeTimeout)


def standing(found: DataFrame) -> DataFrame:
    """uid, status, due as of the last transition of each key."""
    return found.groupBy("uid").agg(F.max(F.struct("at", "due", "status")).alias("last")).select("uid", "last.status", "last.due")
