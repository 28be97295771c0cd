"""Alert mails: read, cut into cards, failing closed."""

from pyspark.sql import functions as F

from sievelake.sources import mail

PORTAL = mail.Portal("jobs", "jobs.test", r"(?s)<td>(.*?)</td>", r'href="([^"]+)"', r"(?s)<a[^>]*>(.*?)</a>", r"(?s)<b>(.*?)</b>", r"(?s)<i>(.*?)</i>")
CARD = '<td><a href="https://jobs.test/{0}">Dev &amp; Ops {0}</a><b>Acme</b><i>Lima</i></td>'


def message(sender, html):
    return f"From: Alerts <{sender}>\r\nSubject: New jobs\r\nContent-Type: text/html; charset=utf-8\r\n\r\n{html}"


def test_cards(spark):
    raw = [message("a@mail.jobs.test", CARD.format(1) + CARD.format(2)), message("a@jobs.test", "<p>none</p>"), message("x@other.test", CARD.format(3)), message("a@jobs.test", CARD.format(4) + "<td>no link</td>"), "", None]
    rows = mail.messages(spark.createDataFrame([(r,) for r in raw], "value string"))
    assert [r["ok"] for r in rows.collect()] == [True, True, True, True, False, False]
    good, bad = mail.cards(rows.where("ok"), [PORTAL])
    got = {(r["portal"], r["url"], r["title"], r["company"], r["location"]) for r in good.collect()}
    assert got == {("jobs", f"https://jobs.test/{k}", f"Dev & Ops {k}", "Acme", "Lima") for k in (1, 2)}
    assert sorted(r["reason"] for r in bad.collect()) == ["incomplete card", "no cards", "unknown sender"]
    assert rows.where("ok").select(mail.registrable_domain(F.col("sender")).alias("d")).first()["d"] == "jobs.test"
    assert "Acme" not in rows.where("ok").select(mail.skeleton(F.col("html")).alias("s")).first()["s"]
