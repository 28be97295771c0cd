"""A work queue and its guard as stateful streams: state for each task or lane, timers for leases and pauses.

Both take events in the order of their time. Within a micro-batch rows are sorted; a row that comes in a later batch than a younger one counts from then on. What a
timer would have done by the time of the next event is done before it, so a run over old events comes to the same as a live one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from sievelake.session import ship

#: Transitions of tasks, numbered from 1 for each; ``at_ms``: milliseconds since the epoch.
TRANSITIONS = "task string, step long, at_ms long, event string, status string, attempts int, run_after_ms long"
_TASK = "status string, attempts int, run_after_ms long, locked_ms long, step long"
VERDICTS = "id long, lane string, verdict string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session of its own for streams with state of this kind: they need the RocksDB store, and other streams keep theirs."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(key, spark.conf.get(key))
    return own


def _millis(at: pd.Series) -> pd.Series:
    return at.astype("datetime64[ms]").astype("int64")


class _Queue(StatefulProcessor):
    """States of one task: pending, processing, done, failed."""

    def __init__(self, max_attempts: int, first_s: int, longest_s: int, lease_s: int):
        self.max_attempts, self.first_s, self.longest_s, self.lease_ms = max_attempts, first_s, longest_s, lease_s * 1000

    def init(self, handle) -> None:
        self.handle = handle
        self.task = handle.getValueState("task", _TASK)

    def _load(self) -> tuple[tuple, int]:
        """(state, changes so far)"""
        own = tuple(self.task.get()) if self.task.exists() else (None, 0, None, None, 0)
        return own[:4], own[4]

    def _stale(self, now: int, status, attempts, due, locked) -> bool:
        return status == "processing" and locked + self.lease_ms <= now

    def _step(self, now: int, event: str, status, attempts, due, locked) -> tuple | None:
        """The state after an event, or None if the event doesn't fit it."""
        if event == "enqueue" and status is None:
            return "pending", 0, now, None
        if event == "dequeue" and status == "pending" and due <= now:
            return "processing", attempts + 1, due, now
        if status != "processing":
            return None
        if event == "ack":
            return "done", attempts, due, None
        if event == "release":
            return "pending", max(0, attempts - 1), now, None
        if event == "fail" and attempts >= self.max_attempts:
            return "failed", attempts, due, None
        if event == "fail":
            return "pending", attempts, now + 1000 * min(self.longest_s, self.first_s << (attempts - 1)), None
        return None

    def _frame(self, key: str, rows: list[tuple], changes: int) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["at_ms", "event", "status", "attempts", "run_after_ms"])
        out.insert(0, "step", range(changes + 1, changes + 1 + len(rows)))
        out.insert(0, "task", key)
        return out.astype({"attempts": "int32", "run_after_ms": "int64", "at_ms": "int64"})

    def _keep(self, state: tuple, changes: int) -> None:
        self.task.update((*state, changes))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if state[0] == "processing":
            self.handle.registerTimer(state[3] + self.lease_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        (state, changes), out = self._load(), []
        every = pd.concat(rows)
        every = every.assign(at_ms=_millis(every["ts"])).sort_values(["ts", "seq"])
        for now, event in zip(every["at_ms"].tolist(), every["event"].tolist(), strict=True):
            if self._stale(now, *state):
                at = state[3] + self.lease_ms
                state = ("pending", state[1], state[2], None)
                out.append((at, "stale", *state[:3]))
            after = self._step(now, event, *state)
            if after is not None:
                state = after
                out.append((now, event, *state[:3]))
        if out:
            self._keep(state, changes + len(out))
            yield self._frame(key[0], out, changes)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        (state, changes), at = self._load(), expiredTimerInfo.getExpiryTimeInMs()
        if self._stale(at, *state):
            state = ("pending", state[1], state[2], None)
            self.task.update((*state, changes + 1))
            yield self._frame(key[0], [(at, "stale", *state[:3])], changes)

    def close(self) -> None:
        pass


def queue_transitions(events: DataFrame, max_attempts: int = 3, first_s: int = 60, longest_s: int = 3600, lease_s: int = 900, lateness: str = "0 seconds") -> DataFrame:
    """(task, step, at_ms, event, status, attempts, run_after_ms): each change of a task, from a stream (task string, ts, seq, event) of enqueue, dequeue, ack, fail and release.

    A dequeue leases a task that is pending and due; after ``lease_s`` without an answer a timer takes the lease back (``stale``), once the watermark has passed it. Fail tries again after
    ``first_s``, doubled with each attempt up to ``longest_s``, and gives up after ``max_attempts``; release gives the attempt back. Events that don't fit the state
    change nothing. Rows without a task, a time or an event are left out; equal times go by ``seq``.
    """
    ship(events.sparkSession)
    rows = events.select("task", "ts", "seq", "event").where("task IS NOT NULL AND ts IS NOT NULL AND event IS NOT NULL").withWatermark("ts", lateness)
    return rows.groupBy("task").transformWithStateInPandas(_Queue(max_attempts, first_s, longest_s, lease_s), TRANSITIONS, "Append", "EventTime")


class _Guard(StatefulProcessor):
    """What a lane has spent, by owner and minute, and how its calls ended last."""

    def __init__(self, cap: int, own_cap: int, reserved: float, floor: float, failures: int, pause_s: int, window_s: int):
        self.cap, self.own_cap, self.reserved, self.floor = cap, own_cap, reserved, floor
        self.failures, self.pause_ms, self.window_ms = failures, pause_s * 1000, window_s * 1000

    def init(self, handle) -> None:
        self.handle = handle
        self.spent = handle.getMapState("spent", "owner string, at_ms long", "cents long")
        self.row = handle.getValueState("row", "failed int, last_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        every = pd.concat(rows)
        every = every.assign(at_ms=_millis(every["ts"])).sort_values(["ts", "id"])
        known = {tuple(k): v[0] for k, v in self.spent.iterator()}
        before = dict(known)
        failed, last = tuple(self.row.get()) if self.row.exists() else (0, None)
        line = sorted((at, owner, cents) for (owner, at), cents in known.items())
        total, mine, first = 0, {}, 0
        for _, owner, cents in line:
            total += cents
            mine[owner] = mine.get(owner, 0) + cents
        out = []
        for i, now, owner, event, cents in zip(every["id"].tolist(), every["at_ms"].tolist(), every["owner"].tolist(), every["event"].tolist(), every["cents"].tolist(), strict=True):
            while first < len(line) and line[first][0] <= now - self.window_ms:
                at, who, gone = line[first]
                total -= gone
                mine[who] -= gone
                known.pop((who, at), None)
                first += 1
            if event == "ask":
                own = mine.get(owner, 0)
                if failed >= self.failures and now < last + self.pause_ms:
                    verdict = "breaker"
                elif self.cap > 0 and total >= self.cap:
                    verdict = "cap"
                elif self.cap > 0 and total >= self.cap * (1 - self.reserved) and own >= self.cap * self.floor:
                    verdict = "reserved"
                elif self.own_cap > 0 and own >= self.own_cap:
                    verdict = "own_cap"
                else:
                    verdict = "ok"
                out.append((i, key[0], verdict))
                continue
            cents = int(cents or 0)
            if cents:
                total += cents
                mine[owner] = mine.get(owner, 0) + cents
                line.append((now, owner, cents))
                known[(owner, now)] = known.get((owner, now), 0) + cents
            failed, last = (failed + 1, now) if event == "failure" else (0, last)
        for k in before.keys() - known.keys():
            self.spent.removeKey(k)
        for k, v in known.items():
            if before.get(k) != v:
                self.spent.updateValue(k, (v,))
        self.row.update((failed, last))
        if out:
            yield pd.DataFrame(out, columns=["id", "lane", "verdict"])

    def close(self) -> None:
        pass


def guard_verdicts(events: DataFrame, cap: int, own_cap: int, reserved: float = 0.2, floor: float = 0.05, failures: int = 5, pause_s: int = 600, window_s: int = 86_400) -> DataFrame:
    """(id, lane, verdict) for each ``ask`` of a stream (id, lane, owner, ts, event, cents) of ask, success and failure; the latter two carry what the call cost.

    breaker: the last ``failures`` calls failed, the last of them less than ``pause_s`` ago. cap: the lane spent ``cap`` in the window. reserved: it spent all but the reserved share, which is
    left to owners who spent less than ``floor`` of the cap. own_cap: the owner spent that much. Else ok. A cap of 0 does not apply. A lane is one key, as its
    calls wait for each other; its state is what was spent in the window.
    """
    ship(events.sparkSession)
    rows = events.select("id", "lane", "owner", "ts", "event", "cents").where("lane IS NOT NULL AND ts IS NOT NULL").fillna({"owner": ""})
    return rows.groupBy("lane").transformWithStateInPandas(_Guard(cap, own_cap, reserved, floor, failures, pause_s, window_s), VERDICTS, "Append", "None")


def run_once(stream: DataFrame, out: str, checkpoint_dir: str) -> DataFrame:
    """All that the stream has now, written as Parquet; its rows."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint_dir).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
