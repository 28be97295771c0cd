"""The queue and its guard as streams, against plain versions."""

import datetime
import random

import pytest

from sievelake.streaming import queue

T0 = datetime.datetime(2024, 1, 1)
at = lambda s: T0 + datetime.timedelta(seconds=s)
ms = lambda s: int((T0.replace(tzinfo=datetime.timezone.utc).timestamp() + s) * 1000)
LOG = [
    *[("1", s, e) for s, e in [(0, "enqueue"), (5, "dequeue"), (9, "ack"), (10, "fail")]],
    *[("2", s, e) for s, e in [(0, "enqueue"), (5, "dequeue"), (9, "fail"), (20, "dequeue"), (70, "dequeue"), (75, "fail"), (196, "dequeue"), (200, "fail"), (900, "dequeue")]],
    *[("3", s, e) for s, e in [(0, "enqueue"), (5, "dequeue"), (1001, "dequeue"), (1005, "release")]],
    *[("4", s, e) for s, e in [(3, "ack"), (4, "enqueue"), (4, "enqueue")]],
    *[("5", s, e) for s, e in [(0, "enqueue"), (7, "dequeue")]],
    *[("6", s, e) for s, e in [(0, "enqueue"), (1995, "dequeue")]],
    ("7", 2000, "enqueue"), (None, 1, "enqueue"),
]
LAST = {"1": ("done", 1), "2": ("failed", 3), "3": ("pending", 1), "4": ("pending", 0), "5": ("pending", 1), "6": ("processing", 1), "7": ("pending", 0)}


def stream_of(session, path, rows, shape, parts, ts=1):
    rows = sorted(rows, key=lambda r: r[ts])
    for k in range(parts):
        own = rows[k * len(rows) // parts : (k + 1) * len(rows) // parts]
        session.createDataFrame(own, shape).coalesce(1).write.mode("append").parquet(path)
    return session.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.mark.parametrize("parts", [1, 3])
def test_queue(spark, tmp_path, parts):
    session = queue.stateful_session(spark)
    rows = [(t, at(s), k, e) for k, (t, s, e) in enumerate(LOG)]
    stream = stream_of(session, str(tmp_path / "in"), rows, "task string, ts timestamp, seq long, event string", parts)
    got = queue.run_once(queue.queue_transitions(stream), str(tmp_path / "out"), str(tmp_path / "at")).collect()
    last = {}
    for r in sorted(got, key=lambda r: r["step"]):
        last[r["task"]] = (r["status"], r["attempts"])
    assert last == LAST
    stale = {(r["task"], r["at_ms"]) for r in got if r["event"] == "stale"}
    assert stale == {("3", ms(905)), ("5", ms(907))}  # the lease of 6 is not over
    assert [r["run_after_ms"] for r in sorted(got, key=lambda r: r["at_ms"]) if r["task"] == "2" and r["event"] == "fail"] == [ms(69), ms(195), ms(69 + 126)]


def plain_guard(rows, cap, own_cap):
    out, spent, failed, last = {}, [], 0, None
    for i, _, owner, ts, event, cents in sorted(rows, key=lambda r: (r[3], r[0])):
        now = ts.timestamp()
        live = [(o, c) for t, o, c in spent if t > now - 86_400]
        total, mine = sum(c for _, c in live), sum(c for o, c in live if o == owner)
        if event == "ask":
            tests = [(failed >= 5 and now < (last or 0) + 600, "breaker"), (total >= cap, "cap"), (total >= 0.8 * cap and mine >= 0.05 * cap, "reserved"), (mine >= own_cap, "own_cap")]
            out[i] = next((name for holds, name in tests if holds), "ok")
        else:
            spent.append((now, owner, cents))
            failed, last = (failed + 1, now) if event == "failure" else (0, last)
    return out


@pytest.mark.parametrize("parts", [1, 3])
def test_guard(spark, tmp_path, parts):
    r = random.Random(parts)
    rows = [(k, f"lane{k % 2}", f"o{r.randrange(6)}", at(60 * k + r.randrange(60)), r.choices(["ask", "success", "failure"], [2, 1, 3])[0], r.randrange(0, 9)) for k in range(2500)]
    session = queue.stateful_session(spark)
    shape = "id long, lane string, owner string, ts timestamp, event string, cents long"
    stream = stream_of(session, str(tmp_path / "in"), rows, shape, parts, ts=3)
    got = {x["id"]: x["verdict"] for x in queue.run_once(queue.guard_verdicts(stream, cap=1900, own_cap=300), str(tmp_path / "out"), str(tmp_path / "at")).collect()}
    expected = plain_guard([x for x in rows if x[1] == "lane0"], 1900, 300) | plain_guard([x for x in rows if x[1] == "lane1"], 1900, 300)
    assert got == expected and {"ok", "breaker", "reserved"} <= set(got.values())
