"""Feeds of postings as rows of one schema. Payloads are landed as JSON lines or XML files; each reader declares its schema, so
nothing is inferred and only the named fields are parsed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.functions.text import html_to_text, squash

#: One posting, whatever its feed. A null array is unknown; an empty one is known to be empty.
POSTING = (
    "source string, external_id string, url string, title string, company string, location string, countries array<string>, modality string, "
    "salary_min bigint, salary_max bigint, salary_period string, posted_at timestamp, tags array<string>, body string"
)

_ITEMS = {
    "remoteok": "id string, epoch bigint, company string, position string, tags array<string>, description string, location string, salary_min bigint, salary_max bigint, url string",
    "jobicy": "id string, url string, jobTitle string, companyName string, jobIndustry array<string>, jobType array<string>, jobGeo string, jobLevel string, jobDescription string, pubDate string, annualSalaryMin bigint, annualSalaryMax bigint",
    "himalayas": "title string, companyName string, employmentType string, minSalary bigint, maxSalary bigint, locationRestrictions array<string>, categories array<string>, description string, pubDate bigint, guid string",
    "getonboard": "id string, type string, attributes struct<title:string,description:string,remote_modality:string,countries:array<string>,lang:string,category_name:string,min_salary:bigint,max_salary:bigint,published_at:bigint>, links struct<public_url:string>",
    "torre": "id string, objective string, type string, organizations array<struct<name:string>>, locations array<string>, remote boolean, compensation struct<data:struct<minAmount:double,maxAmount:double,currency:string,periodicity:string>>, skills array<struct<name:string>>, created string",
    "board": "id string, title string, content string, absolute_url string, updated_at string, location struct<name:string>",
}
#: Where a payload holds its items: a field, or the payload itself is the array.
_CONTAINER = {"remoteok": None, "jobicy": "jobs", "himalayas": "jobs", "getonboard": "data", "torre": "results", "board": "jobs"}


def items(payloads: DataFrame, feed: str) -> DataFrame:
    """One row for each item of ``payloads`` (``value``: a JSON text); malformed payloads give none."""
    item, field = _ITEMS[feed], _CONTAINER[feed]
    kind = f"array<struct<{', '.join(_typed(item))}>>"
    parsed = F.from_json("value", kind if field is None else f"struct<{field}:{kind}>")
    return payloads.select(F.explode(parsed if field is None else parsed[field]).alias("i")).select("i.*")


def _typed(ddl: str) -> list[str]:
    """``name type`` pairs of a DDL list as ``name:type``, leaving nested types alone."""
    out, depth, start = [], 0, 0
    for k, c in enumerate(ddl + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            name, _, kind = ddl[start:k].strip().partition(" ")
            out.append(f"{name}:{kind}")
            start = k + 1
    return out


def _posting(df: DataFrame, source: str, **columns: Column) -> DataFrame:
    fields = [f.strip().split(" ") for f in POSTING.split(", ")]
    columns = {"source": F.lit(source)} | columns
    return df.select(*[columns.get(n, F.lit(None)).cast(k).alias(n) for n, k in fields])


def _amount(c: str) -> Column:
    """Zero stands for unknown."""
    return F.when(F.col(c) > 0, F.col(c))


def _period(known: Column, period: str) -> Column:
    return F.when(known.isNotNull(), period)


def remoteok(payloads: DataFrame) -> DataFrame:
    """The first element is a legal notice without a position."""
    df = items(payloads, "remoteok").where("position is not null")
    return _posting(
        df, "remoteok", external_id=F.col("id"), url=F.col("url"), title=squash(F.col("position")), company=F.col("company"), location=F.nullif(F.trim("location"), F.lit("")), modality=F.lit("remoto"),
        salary_min=_amount("salary_min"), salary_max=_amount("salary_max"), salary_period=_period(_amount("salary_max"), "anual"), posted_at=F.timestamp_seconds("epoch"), tags=F.col("tags"), body=html_to_text(F.col("description")),
    )


def jobicy(payloads: DataFrame) -> DataFrame:
    """Dates have no zone and are read as UTC."""
    return _posting(
        items(payloads, "jobicy"), "jobicy", external_id=F.col("id"), url=F.col("url"), title=squash(F.col("jobTitle")), company=F.col("companyName"), location=F.col("jobGeo"), modality=F.lit("remoto"),
        salary_min=_amount("annualSalaryMin"), salary_max=_amount("annualSalaryMax"), salary_period=_period(_amount("annualSalaryMax"), "anual"),
        posted_at=F.try_to_timestamp("pubDate", F.lit("yyyy-MM-dd HH:mm:ss")), tags=F.col("jobIndustry"), body=html_to_text(F.col("jobDescription")),
    )


def himalayas(payloads: DataFrame) -> DataFrame:
    return _posting(
        items(payloads, "himalayas"), "himalayas", external_id=F.col("guid"), url=F.col("guid"), title=squash(F.col("title")), company=F.col("companyName"), location=F.array_join("locationRestrictions", ", "),
        countries=F.col("locationRestrictions"), modality=F.lit("remoto"), salary_min=_amount("minSalary"), salary_max=_amount("maxSalary"), salary_period=_period(_amount("maxSalary"), "anual"),
        posted_at=F.timestamp_seconds("pubDate"), tags=F.col("categories"), body=html_to_text(F.col("description")),
    )


def getonboard(payloads: DataFrame) -> DataFrame:
    a = lambda n: F.col(f"attributes.{n}")
    modality = F.when(a("remote_modality").isin("fully_remote", "remote_local"), "remoto").when(a("remote_modality") == "hybrid", "hibrido").when(a("remote_modality") == "no_remote", "presencial")
    return _posting(
        items(payloads, "getonboard"), "getonboard", external_id=F.col("id"), url=F.col("links.public_url"), title=squash(a("title")), countries=a("countries"), modality=modality,
        salary_min=a("min_salary"), salary_max=a("max_salary"), salary_period=_period(a("max_salary"), "mensual"), posted_at=F.timestamp_seconds(a("published_at")), tags=F.array(a("category_name")), body=html_to_text(a("description")),
    )


def torre(payloads: DataFrame) -> DataFrame:
    pay = lambda n: F.col(f"compensation.data.{n}")
    usd = F.lower(pay("currency")).isin("usd", "usd$", "us$")
    period = F.when(pay("periodicity") == "monthly", "mensual").when(pay("periodicity") == "yearly", "anual").when(pay("periodicity") == "hourly", "hora")
    return _posting(
        items(payloads, "torre"), "torre", external_id=F.col("id"), url=F.concat(F.lit("https://torre.ai/post/"), "id"), title=squash(F.col("objective")), company=F.try_element_at("organizations", F.lit(1))["name"],
        location=F.array_join("locations", ", "), modality=F.when(F.col("remote"), "remoto"), salary_min=F.when(usd, pay("minAmount")), salary_max=F.when(usd, pay("maxAmount")), salary_period=F.when(usd, period),
        posted_at=F.try_to_timestamp("created"), tags=F.transform("skills", lambda s: s["name"]), body=F.col("objective"),
    )


def company_board(payloads: DataFrame, company: str) -> DataFrame:
    """A company's own board."""
    return _posting(
        items(payloads, "board"), "board", external_id=F.col("id"), url=F.col("absolute_url"), title=squash(F.col("title")), company=F.lit(company), location=F.col("location.name"), posted_at=F.try_to_timestamp("updated_at"), body=html_to_text(F.col("content")),
    )


def rss(spark: SparkSession, path: str, source: str) -> DataFrame:
    """RSS items; a title "Company: Position" is split at its first colon."""
    df = spark.read.format("xml").option("rowTag", "item").schema("title string, link string, guid string, pubDate string, description string, category string").load(path)
    split = F.split("title", r":\s+", 2)
    named = F.size(split) == 2
    when = F.regexp_replace("pubDate", r"^\w{3}, ", "")
    return _posting(
        df, source, external_id=F.coalesce("guid", "link"), url=F.col("link"), title=squash(F.when(named, split[1]).otherwise(F.col("title"))), company=F.when(named, F.trim(split[0])), modality=F.lit("remoto"),
        posted_at=F.try_to_timestamp(when, F.lit("d MMM yyyy HH:mm:ss Z")), tags=F.array("category"), body=html_to_text(F.col("description")),
    )


def since(runs: DataFrame, now: Column, overlap_hours: int = 6, most_days: int = 30, backfill_days: int = 14) -> DataFrame:
    """(source, since) from ``runs`` (source, ok, finished_at): the last good run less an overlap, ``most_days`` ago at most; without one a backfill."""
    last = runs.groupBy("source").agg(F.max(F.when(F.col("ok"), F.col("finished_at"))).alias("last"))
    back = lambda hours: now - F.make_dt_interval(F.lit(0), F.lit(hours))
    wanted = F.greatest(F.col("last") - F.make_dt_interval(F.lit(0), F.lit(overlap_hours)), back(24 * most_days))
    return last.select("source", F.when(F.col("last").isNotNull(), wanted).otherwise(back(24 * backfill_days)).alias("since"))


def field_presence(payloads: DataFrame, feed_column: str = "feed") -> DataFrame:
    """How often each top-level field of JSON objects is present, and with which types."""
    variant = F.try_parse_json("value")
    fields = F.map_keys(F.from_json("value", "map<string,string>"))
    rows = payloads.select(feed_column, F.explode(fields).alias("field"), variant.alias("v"))
    kind = F.schema_of_variant(F.try_variant_get("v", F.concat(F.lit("$['"), "field", F.lit("']")), "variant"))
    return rows.groupBy(feed_column, "field").agg(F.count("*").alias("present"), F.array_sort(F.collect_set(kind)).alias("types"))


def invites(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(good, bad) rows of a CSV with header email, name; bad ones say why."""
    df = spark.read.option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "raw").schema("email string, name string, raw string").csv(path)
    email = F.lower(F.trim("email"))
    why = F.when(F.col("raw").isNotNull(), "malformed row").when(email.isNull(), "no email").when(~email.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"), "invalid email")
    rows = df.select(email.alias("email"), F.trim("name").alias("name"), why.alias("why"))
    return rows.where("why is null").select("email", "name").dropDuplicates(["email"]), rows.where("why is not null")


def classify_mail(mail: DataFrame, confirmation_sender: str, application_domain: str) -> DataFrame:
    """Adds ``kind`` to (sender, subject, text): forward_confirmation, security, application_viewed, application_sent or normal, in this
    order: a confirmation carries a code, so it must be told before security mail is."""
    subject, body = F.lower(F.coalesce("subject", F.lit(""))), F.lower(F.substring(F.coalesce("text", F.lit("")), 1, 65536))
    domain = F.lower(F.regexp_extract("sender", r"@([^\s>]+)", 1))
    own = (domain == application_domain) | domain.endswith("." + application_domain)
    kind = (
        F.when(F.lower("sender").contains(confirmation_sender) & subject.rlike(r"confirm|forward"), "forward_confirmation")
        .when(subject.rlike(r"verification code|security alert|password|codigo de verificacion|contraseña") | body.rlike(r"\b(your code is|codigo es)\b"), "security")
        .when(own & subject.rlike(r"viewed|vist[ao]"), "application_viewed")
        .when(own & subject.rlike(r"application (was )?sent|postulacion (fue )?enviada"), "application_sent")
        .otherwise("normal")
    )
    return mail.withColumn("kind", kind)
