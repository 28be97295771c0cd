"""Candidates of all people against a plain search of each."""

import random

import pytest
from pyspark.sql import functions as F

from sievelake.operators import selection

r = random.Random(3)
ROLES = ["data", "ops", "web", "qa"]


def tables(n_people=25, n_pool=400):
    people = [(f"p{k}", sorted(r.sample(ROLES, r.randrange(0, 4)))) for k in range(n_people)]
    pool = [(k, r.sample(ROLES + ["other"], r.choice([0, 1, 1, 2])), r.choice([None, *range(40)]), r.choice([None, f"u{r.randrange(300)}"]), r.choice([None, f"h{r.randrange(300)}"]), " ".join(r.sample(ROLES, r.choice([0, 0, 1, 2])))) for k in range(n_pool)]
    owned = []
    for u, _ in people:
        for _ in range(r.randrange(0, 12)):
            owned.append((u, *r.choice([(r.randrange(n_pool), None, None), (None, f"u{r.randrange(300)}", None), (None, None, f"h{r.randrange(300)}")])))
    owned += [("p1", k, None, None) for k in range(0, n_pool, 2)] + [(None, 3, None, None), ("p2", None, None, None), ("nobody", 5, None, None)]
    return people, pool, owned


def plain(people, pool, owned, k):
    out = set()
    for u, roles in people:
        mine = [o for o in owned if o[0] == u]
        ids, urls, hashes = ({o[c] for o in mine} - {None} for c in (1, 2, 3))
        own = []
        for i, hints, posted, url, h, title in pool:
            if (not hints or set(hints) & set(roles)) and i not in ids and url not in urls and h not in hashes:
                strong, exact = bool(set(title.split()) & set(roles)), bool(set(hints) & set(roles))
                own.append(((not strong, not exact, posted is None, -(posted or 0), i), i))
        out |= {(u, i, p) for p, (_, i) in enumerate(sorted(own)[:k], 1)}
    return out


@pytest.mark.parametrize("most_owned", [1000, 8])
def test_candidates(spark, most_owned):
    people, pool, owned = tables()
    frames = (
        spark.createDataFrame(people, "user string, roles array<string>"),
        spark.createDataFrame(pool, "id long, hints array<string>, posted long, url string, hash string, title string").repartition(3),
        spark.createDataFrame(owned, "user string, pool_id long, url string, hash string"),
    )
    got = selection.candidates(*frames, F.filter(F.split("title", " "), lambda x: x != ""), k=15, most_owned=most_owned)
    assert {(x["user"], x["id"], x["position"]) for x in got.collect()} == plain(people, pool, owned, 15)
    wide = selection.hydrated(got, frames[1], ["title"])
    assert wide.count() == got.count() and "title" in wide.columns


def test_nobody_and_nothing(spark):
    people = spark.createDataFrame([("a", None), ("b", ["data", None]), (None, ["data"])], "user string, roles array<string>")
    pool = spark.createDataFrame([(1, None, None, None, None, ""), (2, ["data"], 5, "u", "h", "")], "id long, hints array<string>, posted long, url string, hash string, title string")
    owned = spark.createDataFrame([], "user string, pool_id long, url string, hash string")
    named = F.array().cast("array<string>")
    assert {(x["user"], x["id"], x["position"]) for x in selection.candidates(people, pool, owned, named, k=3).collect()} == {("a", 1, 1), ("b", 2, 1), ("b", 1, 2)}
    assert selection.candidates(people.limit(0), pool, owned, named).count() == 0 and selection.candidates(people, pool.limit(0), owned, named).count() == 0


def test_top_k_keeps_a_few_of_a_hot_key(spark, monkeypatch):
    rows = spark.range(20_000).select(F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 2 == 0, F.lit(None)).otherwise("cold").alias("key"), F.when(F.col("id") % 50 > 0, F.col("id") % 977).alias("v"), "id").repartition(4)
    got = selection.top_k(rows, ["key"], [("v", "descending"), ("id", "ascending")], 7).collect()
    expected = set()
    for key in ("hot", "cold", None):
        own = [(i % 50 == 0, -(i % 977) if i % 50 else 0, i) for i in range(20_000) if (key == "hot") == (i % 3 > 0) and (i % 3 > 0 or (key is None) == (i % 2 == 0))]
        expected |= {(key, i, p) for p, (_, _, i) in enumerate(sorted(own)[:7], 1)}
    assert {(x["key"], x["id"], x["position"]) for x in got} == expected


def test_windows(spark):
    rows = [(1, "2024-05-30", "2024-05-01", "feed"), (2, "2024-05-10", "2024-05-30", "feed"), (3, "2024-05-31", "2024-01-01", "feed"), (4, "2024-05-31", "2024-01-01", "board"), (5, "2024-05-31", None, "feed"), (6, None, None, "feed"), (7, "2024-05-18", "2024-05-02", None)]
    df = spark.createDataFrame(rows, "id long, seen string, posted string, source string")
    alive = selection.in_windows(F.lit("2024-06-01").cast("timestamp"), F.col("seen").cast("timestamp"), F.col("posted").cast("timestamp"), F.col("source"), ("board",))
    assert {x["id"] for x in df.where(alive).collect()} == {4, 5, 7}


def frames(spark, people, pool, owned):
    return spark.createDataFrame(people, "user string, roles array<string>"), spark.createDataFrame(pool, "id long, hints array<string>, posted long, url string, hash string, title string"), spark.createDataFrame(owned, "user string, pool_id long, url string, hash string")


def titled():
    return F.filter(F.split("title", " "), lambda x: x != "")


def test_people_are_dealt_from_shared_lists(spark, monkeypatch):
    """Wide columns are read before the lists are dealt out. Some own the start of their list, some more than any list may be long."""
    monkeypatch.setattr(selection, "_SHARING", 3)
    people = [(f"p{k}", ["data"] if k < 20 else ["data", "web"]) for k in range(30)]
    pool = [(k, ["data"] if k % 3 else [], 200 - k, f"u{k // 2}", None, "web" if k % 5 == 0 else "") for k in range(120)]
    owned = [("p1", k, None, None) for k in range(14)] + [("p2", k, None, None) for k in range(1, 60) if k % 3] + [("p25", None, f"u{k}", None) for k in range(40)] + [("p26", k, None, None) for k in range(118)] + [("p3", 1, "u0", None), ("p3", 1, "u5", None)]
    got = selection.candidates(*frames(spark, people, pool, owned), titled(), k=5, most_owned=20, columns=["title"])
    assert {(x["user"], x["id"], x["position"]) for x in got.collect()} == plain(people, pool, owned, 5)
    assert all(x["title"] == pool[x["id"]][5] for x in got.collect())


def test_people_are_no_python_groups(spark):
    people, pool, owned = [(f"p{k}", ["data"]) for k in range(20)], [(k, ["data"], k, None, None, "") for k in range(20)], [("p1", 19, None, None)]
    got = selection.candidates(*frames(spark, people, pool, owned), titled(), k=5)
    assert {(x["user"], x["id"], x["position"]) for x in got.collect()} == plain(people, pool, owned, 5)
    assert "InPandas" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_an_empty_role_is_a_role(spark):
    people, pool = [("a", []), ("b", [""]), ("c", ["x,y"]), ("d", ["x", "y"])], [(1, [""], 1, None, None, ""), (2, [], 2, None, None, ""), (3, ["x,y"], 3, None, None, ""), (4, ["y"], 4, None, None, "")]
    got = selection.candidates(*frames(spark, people, pool, []), titled(), k=3)
    assert {(x["user"], x["id"], x["position"]) for x in got.collect()} == plain(people, pool, [], 3)
