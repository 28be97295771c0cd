"""Event-time behaviours as Structured Streaming transforms; each also runs on a batch DataFrame where no state is custom."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: How late an event may be: feeds are read again six hours back.
LATENESS = "6 hours"
#: A key without an event for so long is forgotten: all windows below are over by then.
IDLE_MS = 2 * 3_600_000


def hourly_counts(events: DataFrame, *keys: str, lateness: str = LATENESS) -> DataFrame:
    """Tumbling hours: (hour, keys, hits)."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", "1 hour").alias("w"), *keys).agg(F.count("*").alias("hits")).select(F.col("w.start").alias("hour"), *keys, "hits")


def daily_quota(events: DataFrame, key: str, limit: int, lateness: str = LATENESS) -> DataFrame:
    """Sliding days, moved by an hour: (since, key, hits, over)."""
    w = events.withWatermark("ts", lateness).groupBy(F.window("ts", "24 hours", "1 hour").alias("w"), key).agg(F.count("*").alias("hits"))
    return w.select(F.col("w.start").alias("since"), key, "hits", (F.col("hits") > limit).alias("over"))


def visits(events: DataFrame, key: str, gap: str = "30 minutes", lateness: str = LATENESS) -> DataFrame:
    """Sessions that end after ``gap`` without an event: (key, since, until, hits)."""
    w = events.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("hits"))
    return w.select(key, F.col("w.start").alias("since"), F.col("w.end").alias("until"), "hits")


def first_seen(events: DataFrame, key: str, lateness: str = LATENESS) -> DataFrame:
    """Each key once, however often a source sends it."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark([key])


def minute_limit(events: DataFrame, key: str, limit: int = 60) -> DataFrame:
    """(key, allowed, limited) for each batch: a window of one minute starts with the first event and again when it is over."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, n = state.get if state.exists else (None, 0)
        allowed = limited = 0
        for at in sorted(t for f in frames for t in f["ts"].astype("datetime64[us]").astype("int64")):
            if start is None or at - start > 60_000_000:
                start, n = int(at), 0
            n += 1
            allowed, limited = allowed + (n <= limit), limited + (n > limit)
        if state.hasTimedOut or start is None:
            state.remove()
            return
        state.update((start, n))
        state.setTimeoutDuration(IDLE_MS)
        yield pd.DataFrame({"key": [str(k[0])], "allowed": [allowed], "limited": [limited]})

    rows = events.select(F.col(key).cast("string").alias("key"), "ts")
    return rows.groupBy("key").applyInPandasWithState(run, "key string, allowed long, limited long", "start long, n long", "update", GroupStateTimeout.ProcessingTimeTimeout)


def lockouts(attempts: DataFrame, key: str, free: int = 5, longest: int = 15) -> DataFrame:
    """(key, failures, locked_until): from the ``free``-th failure on a key is locked for 1, 2, 4 ... minutes, ``longest`` at most;
    an idle hour starts anew."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last = state.get if state.exists else (0, None)
        until = None
        for at in sorted(t for f in frames for t in f["ts"].astype("datetime64[us]").astype("int64")):
            n = 1 if last is None or at - last > 3_600_000_000 else n + 1
            last = int(at)
            if n >= free:
                until = last + min(longest, 1 << min(n - free, 20)) * 60_000_000
        if state.hasTimedOut or last is None:
            state.remove()
            return
        state.update((n, last))
        state.setTimeoutDuration(IDLE_MS)
        yield pd.DataFrame({"key": [str(k[0])], "failures": [n], "locked_until": [until]})

    rows = attempts.select(F.col(key).cast("string").alias("key"), "ts")
    return rows.groupBy("key").applyInPandasWithState(run, "key string, failures long, locked_until long", "failures long, last long", "update", GroupStateTimeout.ProcessingTimeTimeout)


def burst_limits(requests: DataFrame, per_key: int = 40, burst: int = 60, per_day: int = 600) -> DataFrame:
    """(id, verdict) for requests (id, ts, key, email) in batch: rate_limited if the key made ``per_key`` requests in the hour before, or all keys together
    ``burst`` in the ten whole minutes or ``per_day`` in the 1,440 before; duplicate if an earlier request has the same mail; else ok.

    Every request counts, also one that was refused: so no verdict waits for another, and keys are worked on apart. Requests without a key share one. Of
    all keys together there is one row for each minute."""
    at, minute = F.unix_micros(F.col("ts").cast("timestamp")), F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 60).cast("long")
    rows = requests.select("id", at.alias("at"), minute.alias("minute"), F.coalesce("key", F.lit("none")).alias("key"), F.lower(F.trim("email")).alias("email"))
    w = Window.orderBy("minute")
    past = lambda n: F.coalesce(F.sum("n").over(w.rangeBetween(-n, -1)), F.lit(0))
    minutes = rows.groupBy("minute").agg(F.count("*").alias("n")).select("minute", past(10).alias("ten"), past(1440).alias("day"))
    own = F.count("*").over(Window.partitionBy("key").orderBy("at").rangeBetween(-3_600_000_000, -1))
    first = rows.groupBy("email").agg(F.min(F.struct("at", "id")).alias("first"))
    met = rows.withColumn("own", own).join(minutes, "minute").join(first, "email", "left")
    limited = (F.col("own") >= per_key) | (F.col("ten") >= burst) | (F.col("day") >= per_day)
    return met.select("id", F.when(limited, "rate_limited").when(F.col("first.id") != F.col("id"), "duplicate").otherwise("ok").alias("verdict"))


def queue_states(events: DataFrame, max_attempts: int = 3, first_s: int = 60, longest_s: int = 3600, lease_s: int = 900) -> DataFrame:
    """(task, status, attempts, run_after_s, locked_s) after a log (task, at_s, seq, event) of enqueue, dequeue, ack, fail, release and stale (a check at that time).

    A dequeue leases a task that is pending and due; fail tries again after ``first_s``, doubled with each attempt up to ``longest_s``, and gives up after
    ``max_attempts``; release gives the attempt back; stale takes back a lease older than ``lease_s``. Events that don't fit the state change nothing. A task's
    log is one group; its length is bounded by its attempts."""
    kind = events.schema["task"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        status, attempts, due, locked = None, 0, 0, None
        for r in pdf.sort_values(["at_s", "seq"]).itertuples():
            if r.event == "enqueue" and status is None:
                status, due = "pending", r.at_s
            elif r.event == "dequeue" and status == "pending" and due <= r.at_s:
                status, attempts, locked = "processing", attempts + 1, r.at_s
            elif status == "processing" and r.event in ("ack", "fail", "release", "stale"):
                if r.event == "ack":
                    status, locked = "done", None
                elif r.event == "fail":
                    status, locked = ("failed" if attempts >= max_attempts else "pending"), None
                    due = r.at_s + min(longest_s, first_s << (attempts - 1)) if status == "pending" else due
                elif r.event == "release":
                    status, attempts, due, locked = "pending", attempts - 1, r.at_s, None
                elif r.at_s - locked > lease_s:
                    status, locked = "pending", None
        return pd.DataFrame({"task": [pdf["task"].iloc[0]], "status": [status], "attempts": [attempts], "run_after_s": [due], "locked_s": pd.array([locked], dtype="Int64")})

    return events.groupBy("task").applyInPandas(run, f"task {kind}, status string, attempts long, run_after_s long, locked_s long")
