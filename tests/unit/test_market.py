"""Markets, snapshots and payloads on small cases."""

import json

from pyspark.sql import functions as F

from sievelake.functions import scrub
from sievelake.operators import market, snapshots


def test_scrub_any_depth(spark):
    deep = "x@y.com"
    for k in range(60):
        deep = {"k": [deep, k]} if k % 2 else [deep]
    cases = [
        {"a@b.com": "write to a@b.com or +54 11 4444-5555", "id": 5491144445555, "url": "https://x.org/4915123456789?m=a@b.com", "list": ["c@d.org", None, True, 1.5, {"t": 'say "hi" to a@b.com\n'}]},
        deep, "plain a@b.com", [], {}, {"e": "escaped"}, {"q": "back\\slash a@b.com", "u": "é ☃"},
    ]
    rows = [(k, json.dumps(c)) for k, c in enumerate(cases)] + [(90, "not json: a@b.com {"), (91, None), (92, '{"x": "a\\u0040b.com"}'), (93, "")]

    def plain(v):
        if isinstance(v, str):
            return v if v.startswith("https://") and " " not in v else v.replace("a@b.com", "[email]").replace("c@d.org", "[email]").replace("x@y.com", "[email]").replace("+54 11 4444-5555", "[phone]")
        if isinstance(v, list):
            return [plain(x) for x in v]
        return {k: plain(x) for k, x in v.items()} if isinstance(v, dict) else v

    got = {r["id"]: r["out"] for r in spark.createDataFrame(rows, "id long, raw string").select("id", scrub.scrubbed(F.col("raw")).alias("out")).collect()}
    assert [json.loads(got[k]) for k in range(len(cases))] == [plain(c) for c in cases]
    assert got[90] == "not json: [email] {" and got[91] is None and json.loads(got[92]) == {"x": "[email]"} and got[93] == ""


def test_weeks_are_replaced_alone(spark, tmp_path):
    path, shape = str(tmp_path / "weeks"), "week_start string, n long"
    frame = lambda rows: spark.createDataFrame(rows, shape)
    read = lambda: {tuple(r) for r in snapshots.read_weeks(spark, path, frame([])).collect()}
    snapshots.replace_weeks(frame([("2024-01-01", 1), ("2024-01-08", 2), ("2024-01-15", 3)]), path, ["2024-01-01", "2024-01-08", "2024-01-15"])
    for _ in range(2):
        snapshots.replace_weeks(frame([("2024-01-08", 20), ("2024-01-08", 21), ("2024-01-15", 9)]), path, ["2024-01-08"])
        assert read() == {("2024-01-01", 1), ("2024-01-08", 20), ("2024-01-08", 21), ("2024-01-15", 3)}
    snapshots.replace_weeks(frame([]), path, ["2024-01-15", "2024-02-05"])
    assert read() == {("2024-01-01", 1), ("2024-01-08", 20), ("2024-01-08", 21)}
    snapshots.replace_weeks(frame([("2024-01-01", 7)]), path, [])
    assert len(read()) == 3


def test_windows_of_weeks(spark):
    rows = spark.createDataFrame([("2024-01-01 00:00:00",), ("2024-01-07 23:59:59",), (None,)], "s string").withColumn("at", F.col("s").cast("timestamp"))
    got = {}
    for r in snapshots.by_week(rows, "at").collect():
        got.setdefault(r["s"], []).append(r["week_start"])
    assert got == {"2024-01-01 00:00:00": ["2024-01-01", "2024-01-08", "2024-01-15", "2024-01-22"], "2024-01-07 23:59:59": ["2024-01-01", "2024-01-08", "2024-01-15", "2024-01-22", "2024-01-29"]}


def test_market_of_nulls(spark):
    shape = "role string, seniority string, written string, asks boolean, english string, modality string, from_country string, source string, published timestamp, local boolean, salary double, skills array<struct<slug:string,is_must:boolean>>"
    rows = [(None,) * 12, ("r", "senior", "es", True, None, None, None, "a", None, True, 5.0, [("x", None), ("x", True), (None, True), ("y", False)])]
    got = {(r["role"], r["block"], r["key"]): (r["n"], r["must"], r["share"]) for r in market.career_market(spark.createDataFrame(rows, shape), F.lit("2024-01-01")).collect()}
    assert got[(None, "seniority", "unknown")] == (1, None, 1.0) and got[("r", "asks_english", "no_level")] == (1, None, 1.0)
    assert got[("r", "skill", "x")] == (1, 1, 1.0) and got[("r", "skill", "y")] == (1, 0, 1.0) and ("r", "skill", None) not in got
    assert not [k for k in got if k[1] == "fresh"] and got[("r", "salary", "local/senior")][0] == 1
