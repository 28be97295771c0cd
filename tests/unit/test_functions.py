"""Column helpers and transforms on small examples."""

import json

import pytest
from pyspark.sql import functions as F

from sievelake.functions import similarity, text, urls
from sievelake.operators.core import anti_join_any, latest_per_key, merge_rows
from sievelake.operators.dedup import near_pairs, pool_duplicates
from sievelake.sources import feeds
from sievelake.streaming import jobs


def one(spark, f, *values):
    row = spark.createDataFrame([values], ", ".join(f"c{k} string" for k in range(len(values))))
    return row.select(f(*[F.col(c) for c in row.columns]).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "expected"),
    [("Acme S.A.", "acme"), ("Acme Inc", "acme"), ("Foo S.R.L.", "foo"), ("Recruiter → Ñandú Corp (AR)", "nandu"), ("Inc", "inc"), ("Acme via Agency", "acme"), ("Beta Co Ltd", "beta"), ("A B", "a b")],
)
def test_company_name(spark, raw, expected):
    assert one(spark, text.company_name, raw) == expected


@pytest.mark.parametrize(
    ("raw", "expected"),
    [("Senior Full-Stack Developer (Remote)", ["fullstack", "developer"]), ("C# / .NET dev", ["csharp", "dotnet", "dev"]), ("Data Data Engineer id123 II", ["data", "engineer"]), ("", [])],
)
def test_title_tokens(spark, raw, expected):
    assert one(spark, text.title_tokens, raw) == expected


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("https://www.Example.com/jobs/?utm_source=x&b=2&a=1#top", "https://example.com/jobs?a=1&b=2"),
        ("https://ar.linkedin.com/jobs/view/dev-at-acme-123456/?trk=x", "https://linkedin.com/jobs/view/123456"),
        ("https://www.linkedin.com/jobs/search?currentJobId=77&x=1", "https://linkedin.com/jobs/view/77"),
        ("https://ar.indeed.com/viewjob?jk=abc&from=z", "https://ar.indeed.com/viewjob?jk=abc"),
        ("ftp://example.com/x", None),
        ("nonsense", None),
    ],
)
def test_canonical_url(spark, raw, expected):
    assert one(spark, urls.canonical_url, raw) == expected
    if expected:
        assert one(spark, urls.canonical_url, expected) == expected


def test_small_text_functions(spark):
    assert one(spark, text.fold, "Ñandú ÉL") == "nandu el"
    assert one(spark, text.strip_brackets, "a (b [c] d) e").split() == ["a", "e"]
    deep = "a " + "(x [" * 40 + "y" + "] z)" * 40 + " b ) c ["
    assert one(spark, text.strip_brackets, deep).split() == ["a", "b", ")", "c", "["] and one(spark, text.strip_brackets, "") == "" and one(spark, text.strip_brackets, "a)") == "a)"
    assert one(spark, text.mask_phones, "call +54 11 4444-5555 or 2019-2023, 2024-01-31, 10.0.0.12") == "call [phone] or 2019-2023, 2024-01-31, 10.0.0.12"
    assert one(spark, text.mask_shape, "Ab1") == "Xx9"
    assert [one(spark, text.seniority_bucket, None, t) for t in ("Semi Senior Dev", "Sr. Dev", "Junior / Senior", "Staff Engineer", "Dev")] == ["semi", "senior", "junior", "lead", "unknown"]
    assert one(spark, urls.base_domain, "mail.empresa.com.ar") == "empresa.com.ar" and one(spark, urls.base_domain, "a.b.example.org") == "example.org"
    assert one(spark, text.html_to_text, "<p>a&amp;b</p><script>x</script><br>c") == "a&b\nc"
    got = spark.sql("select 120000.0 a, 'anual' p union all select 10.0, 'hora' union all select 5.0, null").select(text.monthly_usd(F.col("a"), F.col("p")).alias("x")).collect()
    assert [r["x"] for r in got] == [10000, 1600, None]


def test_similarity(spark):
    def fnv(s):
        h = 2166136261
        for b in s.encode():
            h = ((h ^ b) * 16777619) & 0xFFFFFFFF
        return h

    assert one(spark, similarity.fnv1a, "hello world") == fnv("hello world")
    a, b = " ".join(f"w{k}" for k in range(60)), " ".join(f"w{k}" for k in range(3, 60))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b)]
    expected = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
    assert abs(one(spark, lambda x, y: similarity.jaccard(similarity.shingles(x), similarity.shingles(y)), a, b) - expected) < 1e-12
    assert abs(one(spark, lambda x, y: similarity.sketch_similarity(similarity.sketch(x), similarity.sketch(y)), a, b) - expected) < 1e-12
    assert one(spark, lambda x, y: similarity.jaccard(similarity.shingles(x), similarity.shingles(y)), "", " ") == 0


def pool(spark, rows):
    """(id, company, seen, text), and a url where there is a fifth value; each from a source of its own."""
    full = [(r[0], "s", f"x{r[0]}", r[4] if len(r) > 4 else None, *r[1:4]) for r in rows]
    return spark.createDataFrame(full, "id long, source string, external_id string, url string, company string, seen long, text string")


def test_pool_duplicates(spark):
    base = " ".join(f"w{k}" for k in range(80))
    rows = [(1, "a", 0, base), (2, "a", 1, base + " end"), (3, "b", 1, base + " end more"), (4, "a", 99, base + " end late"), (5, "c", 9, base.upper()), (6, "a", 2, "other text", "u/1"), (7, "a", 3, base + " end x"), (8, "z", 4, "third", "u/1"), (9, None, None, None)]
    got = {r["id"]: (r["root"], r["reason"]) for r in pool_duplicates(pool(spark, rows), window=14).collect()}
    assert got == {1: (1, "new"), 2: (1, "jd_text"), 3: (3, "new"), 4: (4, "new"), 5: (1, "jd_hash"), 6: (6, "new"), 7: (1, "jd_text"), 8: (6, "url"), 9: (9, "new")}
    pairs = near_pairs(spark.createDataFrame([(r[0], r[1], r[3]) for r in rows if r[3]], "id long, block string, text string"))
    assert {(r["a"], r["b"]) for r in pairs.collect()} == {(2, 1), (4, 1), (4, 2), (7, 1), (7, 2), (7, 4)}
    again = pool(spark, [(1, "a", 0, base)]).union(spark.createDataFrame([(2, "s", "x1", None, "a", 5, base)], pool(spark, []).schema))
    assert {r["id"]: (r["root"], r["reason"]) for r in pool_duplicates(again, window=14).collect()} == {1: (1, "new"), 2: (1, "same")}


def test_pool_duplicates_along_a_chain_and_by_copies(spark):
    words = [f"w{k}" for k in range(90)]
    chain = [(k, "a", 10 * k, " ".join(words + [f"t{k}"])) for k in range(20)]  # each is near all others, but in the window of its neighbours only
    got = {r["id"]: (r["root"], r["reason"]) for r in pool_duplicates(pool(spark, chain), window=10).collect()}
    assert got == {0: (0, "new")} | {k: (0, "jd_text") for k in range(1, 20)}
    base = " ".join(words)
    rows = [(1, "a", 0, base), (2, "b", 5, base), (3, "b", 9, base + " end"), (4, "a", 90, base), (5, "a", 95, base + " late"), (6, "c", 96, base + " other"), (7, "c", 97, base)]
    got = {r["id"]: (r["root"], r["reason"]) for r in pool_duplicates(pool(spark, rows), window=14).collect()}
    # 4 comes too late for 1 to 3 and begins a family of its own
    assert got == {1: (1, "new"), 2: (1, "jd_hash"), 3: (1, "jd_text"), 4: (4, "new"), 5: (4, "jd_text"), 6: (6, "new"), 7: (4, "jd_hash")}


def test_merge_rows_with_nulls(spark):
    shape = "id long, a string, b string"
    old = spark.createDataFrame([(1, None, "a"), (2, "x", "b"), (3, "y", "c"), (5, None, None), (None, "n", "n")], shape)
    new = spark.createDataFrame([(1, None, "NEW"), (2, None, "NEW2"), (4, None, "ins"), (5, None, None), (6, None, None), (None, "n", None)], shape)
    got = {tuple(r) for r in merge_rows(old, new, ["id"], ["a", "b"]).collect()}
    assert got == {(1, None, "NEW", "updated"), (2, None, "NEW2", "updated"), (3, "y", "c", "kept"), (4, None, "ins", "inserted"), (5, None, None, "unchanged"), (6, None, None, "inserted"), (None, "n", None, "updated")}


def test_core_transforms(spark):
    df = spark.createDataFrame([(1, 5, "x"), (1, 7, "y"), (2, None, "z")], "k int, t int, v string")
    assert {(r["k"], r["v"]) for r in latest_per_key(df, ["k"], -F.col("t")).collect()} == {(1, "y"), (2, "z")}
    new = spark.createDataFrame([(1, "b"), (3, None), (None, "c")], "id int, u string")
    assert [r["id"] for r in anti_join_any(new, spark.createDataFrame([(1, None), (9, "c")], "id int, u string"), ["id", "u"]).collect()] == [3]
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, v string")
    fresh = spark.createDataFrame([(2, "b"), (3, "d"), (4, "e")], "id int, v string")
    assert {(r["id"], r["v"], r["change"]) for r in merge_rows(old, fresh, ["id"], ["v"]).collect()} == {(1, "a", "kept"), (2, "b", "unchanged"), (3, "d", "updated"), (4, "e", "inserted")}


def test_feeds(spark, tmp_path):
    payload = lambda x: spark.createDataFrame([(json.dumps(x),), ("broken",)], "value string")
    row = feeds.remoteok(payload([{"legal": "notice"}, {"id": "7", "epoch": 0, "position": " Dev  Ops", "company": "Acme", "tags": ["a"], "description": "<p>x</p>", "salary_max": 1000}])).collect()
    assert len(row) == 1 and (row[0]["title"], row[0]["salary_period"], row[0]["salary_min"], row[0]["body"]) == ("Dev Ops", "anual", None, "x")
    assert feeds.jobicy(payload({"jobs": [{"id": 1, "jobTitle": "T", "pubDate": "2024-01-02 03:04:05"}]})).first()["posted_at"].day == 2
    assert feeds.himalayas(payload({"jobs": [{"title": "T", "locationRestrictions": ["Chile", "Peru"]}]})).first()["location"] == "Chile, Peru"
    assert feeds.getonboard(payload({"data": [{"id": "x", "attributes": {"title": "T", "remote_modality": "hybrid"}}]})).first()["modality"] == "hibrido"
    assert feeds.torre(payload({"results": [{"id": "x", "objective": "T", "organizations": [{"name": "O"}], "remote": True}]})).first()["company"] == "O"
    assert feeds.company_board(payload({"jobs": [{"id": 5, "title": "T", "location": {"name": "L"}}]}), "C").first()["location"] == "L"
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>Acme: Data Engineer</title><link>u</link><pubDate>Tue, 02 Jan 2024 03:04:05 +0000</pubDate><description>&lt;p&gt;x&lt;/p&gt;</description></item></channel></rss>")
    got = feeds.rss(spark, str(tmp_path / "f.xml"), "wwr").first()
    assert (got["company"], got["title"], got["body"], got["posted_at"].year) == ("Acme", "Data Engineer", "x", 2024)
    (tmp_path / "i.csv").write_text("email,name\nA@b.co,Ann\na@b.co,Ann\nnope,Bob\n")
    good, bad = feeds.invites(spark, str(tmp_path / "i.csv"))
    assert [r["email"] for r in good.collect()] == ["a@b.co"] and [r["why"] for r in bad.collect()] == ["invalid email"]
    seen = {r["field"]: (r["present"], r["types"]) for r in feeds.field_presence(spark.createDataFrame([("f", '{"a": 1, "b": "x"}'), ("f", '{"a": "y"}')], "feed string, value string")).collect()}
    assert seen["a"] == (2, ["BIGINT", "STRING"]) and seen["b"] == (1, ["STRING"])
    mail = [("forwarding@mail.test", "Confirm forwarding", "code 1"), ("x@y.z", "Security alert", ""), ("jobs@portal.test", "Your application was sent", ""), ("a@b.c", "Hello", None)]
    kinds = [r["kind"] for r in feeds.classify_mail(spark.createDataFrame(mail, "sender string, subject string, text string"), "forwarding@mail.test", "portal.test").collect()]
    assert kinds == ["forward_confirmation", "security", "application_sent", "normal"]
    runs = spark.sql("select 'a' source, true ok, timestamp'2024-01-10 12:00:00' finished_at union all select 'b', false, timestamp'2024-01-10 12:00:00'")
    got = {r["source"]: r["since"].strftime("%d %H") for r in feeds.since(runs, F.lit("2024-01-31 00:00:00").cast("timestamp")).collect()}
    assert got == {"a": "10 06", "b": "17 00"}


def test_streams(spark, tmp_path):
    rows = spark.sql("select 'u' || (id % 2) user, timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, 10 * id) ts, id % 50 event_id from range(100)")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))

    def run(f, mode):
        source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        name = f"out_{mode}_{f.__name__}"
        q = f(source).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    def minute(df):
        return jobs.minute_limit(df, "user", 2)

    def locks(df):
        return jobs.lockouts(df, "user")

    def hours(df):
        return jobs.hourly_counts(df, "user")

    def once(df):
        return jobs.first_seen(df, "event_id")

    limited = run(minute, "update")
    assert {(r["key"], r["allowed"] + r["limited"]) for r in limited} == {("u0", 50), ("u1", 50)} and all(r["limited"] > 0 for r in limited)
    assert {r["failures"] for r in run(locks, "update")} == {50}
    assert sum(r["hits"] for r in run(hours, "complete")) == 100
    assert len(run(once, "append")) == 50
    assert jobs.visits(rows, "user").count() == 2 and jobs.daily_quota(rows, "user", 10).where("over").count() > 0


def test_fold_of_all_code_points(spark):
    import sys
    import unicodedata

    chars = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    rows = ["x".join(chars[k : k + 400]) for k in range(0, len(chars), 400)] + ["ﬁn Ａ Łódź ő", "plain", "É ñ", "", None]
    got = [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "id long, t string").select("id", text.fold_whole(F.col("t")).alias("f")).orderBy("id").select("f").collect()]
    assert got == [None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).lower() for t in rows]
