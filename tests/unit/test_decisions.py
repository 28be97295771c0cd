"""Matching and decisions on small examples."""

from pyspark.sql import functions as F

from sievelake.operators import decisions, matching


def test_longer_terms_mask_shorter_ones(spark):
    docs = spark.createDataFrame([(1, "Java and JavaScript, React Native.\nNice to have: React"), (2, None), (3, "C++ or C#; not C"), (4, "")], "doc_id long, text string")
    taxonomy = [("java", ["Java"]), ("javascript", ["JavaScript", "js"]), ("react", ["React"]), ("react-native", ["React Native"]), ("cpp", ["C++"]), ("c", ["C"])]
    got = {(r["doc_id"], r["slug"], r["must"]) for r in matching.mentions(docs, taxonomy).collect()}
    assert got == {(1, "java", True), (1, "javascript", True), (1, "react-native", True), (1, "react", False), (3, "cpp", True), (3, "c", True)}


def test_location_scope(spark):
    phrases = {"mexico": ["MX"], "new mexico": ["US"], "latin america": ["AR", "MX"], "worldwide": ["*"], "argentina": ["AR"]}
    rows = [("Remote, New Mexico", None), ("México", None), ("Latin America (UTC-3)", None), ("worldwide", None), ("x", ["*"]), ("Argentina", ["CL"]), ("Argentina, Mexico", []), (None, None)]
    df = spark.createDataFrame(rows, "raw string, allowed array<string>").select("raw", matching.location_scope(F.col("raw"), F.col("allowed"), phrases).alias("s"))
    got = [(r["s"]["kind"], r["s"]["countries"]) for r in df.collect()]
    assert got == [("places", ["US"]), ("places", ["MX"]), ("unknown", None), ("any", None), ("any", None), ("places", ["CL"]), ("places", ["AR", "MX"]), ("unknown", None)]
    assert [r[0] for r in df.select(matching.allows_country(F.col("s"), F.lit("AR"))).collect()] == [False, False, True, True, True, False, True, True]


def test_decide_and_checklist(spark):
    df = spark.createDataFrame([(9.0, False, []), (9.0, True, []), (9.0, False, ["x"]), (3.0, False, [])], "s double, late boolean, b array<string>")
    got = df.select(decisions.decide(F.col("s"), [(F.col("late"), 5.0)], [(F.col("late"), 0.5)], F.col("b"), {"save": 4, "apply": 8}).alias("d")).collect()
    assert [(r["d"]["score"], r["d"]["action"]) for r in got] == [(9.0, "apply"), (5.0, "save"), (9.0, "discard"), (3.0, "discard")]
    c = decisions.checklist([("a", F.lit(True), True), ("b", F.lit(None).cast("boolean"), True), ("c", F.lit(False), True)])
    assert tuple(spark.range(1).select(decisions.checklist_counts(c).alias("c")).first()["c"]) == (1, 1, 1, True)


def test_assignment_states_routes_and_reuse(spark):
    rows = spark.createDataFrame([("u", k, k) for k in range(6)] + [("v", 1, 1)], "user string, id int, score int")
    used = spark.createDataFrame([("u", 2)], "user string, n long")
    got = decisions.assign(rows, used, "user", 4, F.desc("score")).collect()
    assert sorted((r["user"], r["id"]) for r in got) == [("u", 4), ("u", 5), ("v", 1)]
    states = decisions.next_state(spark.createDataFrame([("new", "apply"), ("new", "odd")], "status string, event string"), {("new", "apply"): "sent"})
    assert {(r["event"], r["next"], r["valid"]) for r in states.collect()} == {("apply", "sent", True), ("odd", "new", False)}
    gains = spark.createDataFrame([("u", "a", 10.0, [1, 2, 3]), ("u", "b", 2.0, [3]), ("u", "c", 1.0, [3]), ("u", "d", 1.0, [])], "user string, skill string, hours double, postings array<long>")
    assert [(r["step"], r["skill"], r["gained"]) for r in decisions.study_route(gains, "user").orderBy("step").collect()] == [(1, "c", 1), (2, "a", 2)]
    old = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (2, "x", 1)], "k int, v string, at int")
    new = spark.createDataFrame([(1, "y"), (2, "y"), (3, "y")], "k int, v string")
    assert {(r["k"], r["reason"]) for r in decisions.reusable(new, old, "k", ["v"], "at").collect()} == {(1, "ok"), (2, "v"), (3, "no_previous")}
