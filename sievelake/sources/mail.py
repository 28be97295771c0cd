"""Alert mails as postings: raw messages to (sender, subject, html, text), then cards by sender, failing closed."""

from __future__ import annotations

import email
import email.policy
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.functions.text import html_to_text, mask_shape, squash
from sievelake.functions.urls import base_domain


@dataclass(frozen=True)
class Portal:
    """How a sender's mails show postings. Patterns have one group; ``card`` cuts the mail into cards."""

    name: str
    domain: str
    card: str
    url: str
    title: str
    company: str
    location: str


def messages(raw: DataFrame, column: str = "value") -> DataFrame:
    """(sender, subject, html, text, ok) of raw RFC 822 messages; what can't be read has ok false and null fields."""

    def read(value: bytes | str | None) -> tuple:
        try:
            m = email.message_from_bytes(value if isinstance(value, bytes) else (value or "").encode(), policy=email.policy.default)
            parts = {p.get_content_type(): p.get_content() for p in m.walk() if p.get_content_maintype() == "text"}
            sender = m["from"].addresses[0].addr_spec.lower()
            return sender, str(m["subject"] or ""), parts.get("text/html"), parts.get("text/plain"), True
        except (AttributeError, IndexError, LookupError, UnicodeError, ValueError, KeyError):
            return None, None, None, None, False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [read(v) for v in batch.column(0).to_pylist()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.string()) for c in columns[:4]], pa.array(columns[4], pa.bool_())], ["sender", "subject", "html", "text", "ok"])

    return raw.select(column).mapInArrow(run, "sender string, subject string, html string, text string, ok boolean")


def _one(card: Column, pattern: str) -> Column:
    return F.nullif(squash(html_to_text(F.regexp_extract(card, pattern, 1))), F.lit(""))


def cards(mail: DataFrame, portals: list[Portal]) -> tuple[DataFrame, DataFrame]:
    """(postings, quarantine). A mail goes to the portal of its sender's domain (or a subdomain of it); each card must have a url and a title. A mail of
    an unknown sender, without cards, or with an incomplete card goes to quarantine whole, with the reason."""
    domain = F.lower(F.element_at(F.split(F.coalesce("sender", F.lit("")), "@"), -1))
    nothing = F.array().cast("array<struct<url:string,title:string,company:string,location:string>>")
    name, found = F.lit(None).cast("string"), nothing
    for p in portals:
        own = (domain == p.domain) | domain.endswith("." + p.domain)
        name, found = F.when(own, p.name).otherwise(name), F.when(own, _cards(p)).otherwise(found)
    rows = mail.withColumn("portal", name).withColumn("cards", found)
    broken = F.exists("cards", lambda c: c["url"].isNull() | c["title"].isNull())
    rows = rows.withColumn("reason", F.when(F.col("portal").isNull(), "unknown sender").when(F.size("cards") == 0, "no cards").when(broken, "incomplete card"))
    good = rows.where("reason is null").select("portal", "sender", F.explode("cards").alias("c")).select("portal", "sender", "c.*")
    return good, rows.where("reason is not null").drop("cards")


def _cards(p: Portal) -> Column:
    def read(card: Column) -> Column:
        url = F.nullif(F.regexp_extract(card, p.url, 1), F.lit(""))
        return F.struct(url.alias("url"), _one(card, p.title).alias("title"), _one(card, p.company).alias("company"), _one(card, p.location).alias("location"))

    return F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(p.card), 1), read)


def skeleton(html: Column) -> Column:
    """The tags of a mail with its words masked: enough to repair a parser, without the content."""
    return F.regexp_replace(mask_shape(F.regexp_replace(html, r"(?s)(?<=>)[^<]+(?=<)", "text")), r"\s+", " ")


def registrable_domain(sender: Column) -> Column:
    return base_domain(F.lower(F.element_at(F.split(sender, "@"), -1)))
