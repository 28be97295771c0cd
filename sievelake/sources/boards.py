"""Company boards and search feeds as postings, with what they share: work place, locations, salary; and when and how to ask for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelake.functions.text import fold, html_to_text, squash
from sievelake.sources.feeds import _posting

_SCHEMAS = {
    "lever": "array<struct<id:string,text:string,hostedUrl:string,createdAt:bigint,workplaceType:string,descriptionPlain:string,description:string,categories:struct<location:string,allLocations:array<string>,team:string,commitment:string>,salaryRange:struct<min:double,max:double,currency:string,interval:string>>>",
    "ashby": "struct<jobs:array<struct<id:string,title:string,jobUrl:string,isListed:boolean,isRemote:boolean,workplaceType:string,location:string,secondaryLocations:array<struct<location:string>>,department:string,team:string,employmentType:string,publishedAt:string,descriptionPlain:string,descriptionHtml:string>>>",
    "workable": "struct<jobs:array<struct<shortcode:string,id:string,title:string,url:string,shortlink:string,telecommuting:boolean,city:string,state:string,country:string,locations:array<struct<city:string,region:string,country:string,hidden:boolean>>,department:string,employment_type:string,published_on:string,created_at:string,description:string>>>",
    "reliefweb": "struct<data:array<struct<id:string,fields:struct<title:string,body:string,url:string,source:array<struct<name:string>>,country:array<struct<iso3:string,name:string>>,city:array<struct<name:string>>,career_categories:array<struct<name:string>>,job_type:array<struct<name:string>>,date:struct<created:string>>>>>",
    "teamtailor": "struct<items:array<struct<id:string,url:string,title:string,content_html:string,date_published:string,remote_status:string,locations:array<struct<name:string,city:string,country:string>>,department:string>>>",
    "jooble": "struct<jobs:array<struct<id:string,title:string,location:string,link:string,company:string,updated:string,snippet:string,type:string>>>",
}
_FIELD = {"lever": None, "ashby": "jobs", "workable": "jobs", "reliefweb": "data", "teamtailor": "items", "jooble": "jobs"}
#: Items of one board at most, as the boards themselves allow per page; the rest comes with the next page.
PER_BOARD = 200


def board_items(payloads: DataFrame, feed: str, *keep: str) -> DataFrame:
    """One row for each item of JSON texts (``value``); malformed ones give none."""
    parsed = F.from_json("value", _SCHEMAS[feed])
    return payloads.select(*keep, F.explode(parsed if _FIELD[feed] is None else parsed[_FIELD[feed]]).alias("i")).select(*keep, "i.*")


def joined_locations(first: Column, rest: Column, most: int = 20, longest: int = 500) -> Column:
    """Distinct locations, " / " between them, the main one first; null if there are none."""
    every = F.array_distinct(F.filter(F.transform(F.concat(F.array(first), F.coalesce(rest, F.array().cast("array<string>"))), F.trim), lambda x: x.isNotNull() & (x != "")))
    return F.nullif(F.substring(F.array_join(F.slice(every, 1, most), " / "), 1, longest), F.lit(""))


def workplace(kind: Column, is_remote: Column, location: Column) -> Column:
    """remoto, hibrido, presencial or desconocida: what the board declares, else what the location says."""
    said, place = F.lower(F.coalesce(kind, F.lit(""))), fold(F.coalesce(location, F.lit("")))
    return (
        F.when(said.rlike("remote"), "remoto")
        .when(said.rlike("hybrid"), "hibrido")
        .when(said.rlike("on-?site|office"), "presencial")
        .when(F.coalesce(is_remote, F.lit(False)), "remoto")
        .when(place.rlike(r"\b(hybrid|hibrid[oa])\b"), "hibrido")
        .when(place.rlike(r"\b(remote|remoto|remota)\b"), "remoto")
        .otherwise("desconocida")
    )


def pay(low: Column, high: Column, currency: Column, interval: Column) -> tuple[Column, Column, Column]:
    """(min, max, period) in USD; nulls for other currencies, unknown intervals and amounts that aren't positive."""
    said = F.lower(F.coalesce(interval, F.lit("")))
    period = F.when(said.rlike("year|annual"), "anual").when(said.rlike("month"), "mensual").when(said.rlike("hour"), "hora")
    known = (F.upper(currency) == "USD") & period.isNotNull()
    amount = lambda x: F.when(known & (x > 0), x)
    return amount(low), amount(high), F.when(known & ((low > 0) | (high > 0)), period)


def _http(url: Column) -> Column:
    return F.when(F.trim(url).rlike(r"(?i)^https?://[^\s/]+"), F.trim(url))


def _known(df: DataFrame) -> DataFrame:
    """Items without an id, a link or a title are left out."""
    return df.where(F.coalesce("external_id", F.lit("")) != "").where("url is not null").where(F.coalesce("title", F.lit("")) != "")


def lever(payloads: DataFrame, company: str) -> DataFrame:
    df = board_items(payloads, "lever")
    place = joined_locations(F.col("categories.location"), F.col("categories.allLocations"))
    r = "salaryRange."
    low, high, period = pay(F.col(r + "min"), F.col(r + "max"), F.col(r + "currency"), F.col(r + "interval"))
    return _known(_posting(
        df, "lever", external_id=F.col("id"), url=_http(F.col("hostedUrl")), title=squash(html_to_text(F.col("text"))), company=F.lit(company), location=place, modality=workplace(F.col("workplaceType"), F.lit(None).cast("boolean"), place),
        salary_min=low, salary_max=high, salary_period=period, posted_at=F.timestamp_millis("createdAt"), tags=F.array_compact(F.array("categories.team")), body=F.coalesce("descriptionPlain", html_to_text(F.col("description"))),
    ))


def ashby(payloads: DataFrame, company: str) -> DataFrame:
    """Unlisted postings are left out; without an id the last part of the link is one."""
    df = board_items(payloads, "ashby").where(F.coalesce("isListed", F.lit(True)))
    place = joined_locations(F.col("location"), F.transform("secondaryLocations", lambda x: x["location"]))
    own = F.coalesce(F.nullif("id", F.lit("")), F.nullif(F.regexp_extract("jobUrl", r"([^/?#]+)/?(?:[?#].*)?$", 1), F.lit("")))
    return _known(_posting(
        df, "ashby", external_id=own, url=_http(F.col("jobUrl")), title=squash(html_to_text(F.col("title"))), company=F.lit(company), location=place, modality=workplace(F.col("workplaceType"), F.col("isRemote"), place),
        posted_at=F.try_to_timestamp("publishedAt"), tags=F.array_compact(F.array("department", "team")), body=F.coalesce(F.nullif("descriptionPlain", F.lit("")), html_to_text(F.col("descriptionHtml"))),
    ))


def workable(payloads: DataFrame, company: str) -> DataFrame:
    """Remote only if declared; hidden places are not shown."""
    df = board_items(payloads, "workable")
    spelled = lambda *parts: F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), ", ")
    listed = F.transform(F.filter("locations", lambda x: ~F.coalesce(x["hidden"], F.lit(False))), lambda x: spelled(x["city"], x["region"], x["country"]))
    place = joined_locations(F.when(F.coalesce(F.size("locations"), F.lit(0)) <= 0, spelled(F.col("city"), F.col("state"), F.col("country"))), listed)
    return _known(_posting(
        df, "workable", external_id=F.coalesce(F.nullif("shortcode", F.lit("")), "id"), url=F.coalesce(_http(F.col("url")), _http(F.col("shortlink"))), title=squash(html_to_text(F.col("title"))), company=F.lit(company), location=place,
        modality=F.when(F.coalesce("telecommuting", F.lit(False)), "remoto").otherwise("desconocida"), posted_at=F.coalesce(F.try_to_timestamp("published_on"), F.try_to_timestamp("created_at")), tags=F.array_compact(F.array("department")), body=html_to_text(F.col("description")),
    ))


def reliefweb(payloads: DataFrame) -> DataFrame:
    df = board_items(payloads, "reliefweb")
    f = lambda n: F.col(f"fields.{n}")
    names = lambda c: F.transform(c, lambda x: x["name"])
    place = joined_locations(F.try_element_at(names(f("city")), F.lit(1)), names(f("country")))
    row = _posting(
        df, "reliefweb", external_id=F.col("id"), url=F.coalesce(_http(f("url")), F.concat(F.lit("https://reliefweb.int/node/"), "id")), title=squash(f("title")), company=F.coalesce(F.try_element_at(names(f("source")), F.lit(1)), F.lit("desconocida")),
        location=place, countries=names(f("country")), modality=F.when(F.coalesce(F.size(f("country")), F.lit(0)) <= 0, "remoto").otherwise("desconocida"), posted_at=F.try_to_timestamp(f("date.created")), tags=names(f("career_categories")), body=html_to_text(f("body")),
    )
    return _known(row)


def teamtailor(payloads: DataFrame, company: str, longest: int = 200_000) -> DataFrame:
    """The JSON feed; items whose text is over ``longest`` characters are left out, as their feed cuts them."""
    df = board_items(payloads, "teamtailor").where(F.coalesce(F.length("content_html"), F.lit(0)) <= longest)
    spelled = F.transform("locations", lambda x: F.coalesce(F.nullif(F.array_join(F.filter(F.array(x["city"], x["country"]), lambda y: y.isNotNull() & (y != "")), ", "), F.lit("")), x["name"]))
    place = joined_locations(F.lit(None).cast("string"), spelled)
    kind = F.when(F.lower("remote_status") == "fully", "remote").when(F.lower("remote_status").isin("hybrid", "onsite"), F.lower("remote_status"))
    own = F.coalesce(F.nullif("id", F.lit("")), F.nullif(F.regexp_extract("url", r"/jobs/(\d+)", 1), F.lit("")))
    return _known(_posting(
        df, "teamtailor", external_id=own, url=F.when(F.col("url").rlike(r"(?i)^https?://([^/]+\.)?teamtailor\.com/"), F.col("url")), title=squash(html_to_text(F.col("title"))), company=F.lit(company), location=place,
        modality=workplace(kind, F.lit(None).cast("boolean"), place), posted_at=F.try_to_timestamp("date_published"), tags=F.array_compact(F.array("department")), body=html_to_text(F.col("content_html")),
    ))


def jooble(payloads: DataFrame) -> DataFrame:
    """A search feed: titles and places only, of unknown work place."""
    df = board_items(payloads, "jooble")
    return _known(_posting(
        df, "jooble", external_id=F.concat(F.lit("jooble:"), "id"), url=_http(F.col("link")), title=F.substring(squash(html_to_text(F.col("title"))), 1, 300), company=F.coalesce(F.nullif(F.trim("company"), F.lit("")), F.lit("desconocida")),
        location=F.nullif(F.substring(squash(F.col("location")), 1, 300), F.lit("")), modality=F.lit("desconocida"), posted_at=F.try_to_timestamp("updated"), tags=F.array().cast("array<string>"), body=F.lit(None).cast("string"),
    ))


def interval(minimum: Column, last_error: Column) -> Column:
    """The time between two runs: the source's minimum, twice that after it answered that there were too many."""
    return F.when(last_error == "http_429", minimum * 2).otherwise(minimum)


def due_sources(sources: DataFrame, now: Column, budget: Column | int) -> DataFrame:
    """(source, position) of those to ask now: (source, minimum, last_attempt, last_error, cost) whose interval is over, the longest waiting first, those
    never asked before all others, as long as their costs together stay within ``budget``."""
    ready = sources.where(F.col("last_attempt").isNull() | (now - F.col("last_attempt") >= interval(F.col("minimum"), F.col("last_error"))))
    # one row for each source
    w = Window.orderBy(F.asc_nulls_first("last_attempt"), "source")
    ranked = ready.select("source", F.row_number().over(w).alias("position"), F.sum("cost").over(w).alias("spent"))
    return ranked.where(F.col("spent") <= budget).select("source", "position")


def planned_queries(keywords: DataFrame, per_role: int, per_run: int, rotation: int, daily_cap: int = 100) -> DataFrame:
    """(position, role, keyword) of one run: the first ``per_role`` keywords of each role (``role``, ``role_order``, ``place``, ``keyword``), the main one of every
    role first, of which the ``rotation``-th slice is taken round and round."""
    every = keywords.where(F.col("place") < per_role)
    # one row for each keyword of a plan
    ordered = every.select("role", "keyword", (F.row_number().over(Window.orderBy("place", "role_order")) - 1).alias("k"))
    total = ordered.agg(F.count("*").alias("n"))
    n = F.least(F.lit(max(0, min(per_run, daily_cap))), F.col("n"))
    at = F.pmod(F.col("k") - F.lit(rotation) * n, F.col("n"))
    return ordered.join(F.broadcast(total)).withColumn("position", at).where(F.col("position") < n).select("position", "role", "keyword")


def board_states(attempts: DataFrame, gone: tuple[str, ...] = ("http_404", "http_410")) -> DataFrame:
    """(board, status, permanent, pages) from page attempts (board, page, code): the last page's code, ``ok`` without one; a board that is gone isn't asked again."""
    last = attempts.groupBy("board").agg(F.max_by(F.coalesce("code", F.lit("ok")), "page").alias("status"), F.count("*").alias("pages"))
    return last.select("board", "status", F.col("status").isin(*gone).alias("permanent"), "pages")


def without_navigation(html: Column, passes: int = 10) -> Column:
    """Without meta and base tags, also those that appear once others are gone; if any is left after ``passes``, every < is escaped."""
    for _ in range(passes):
        html = F.regexp_replace(html, r"(?is)<\s*/?\s*(?:meta|base)\b[^>]*>?", "")
    return F.when(html.rlike(r"(?is)<\s*/?\s*(?:meta|base)\b"), F.replace(html, F.lit("<"), F.lit("&lt;"))).otherwise(html)


def pasted(text: Column) -> Column:
    """struct<url, title, company, body> of a pasted posting: its first link, its first other line as title, "company: " or "empresa: " lines; the rest is the body."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), F.trim), lambda x: x != "")
    url = F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), r"(https?://[^\s<>\"')]+)", 1), F.lit(""))
    company = F.filter(lines, lambda x: x.rlike(r"(?i)^(company|empresa)\s*:"))
    rest = F.filter(lines, lambda x: ~x.rlike(r"(?i)^(company|empresa)\s*:|^https?://\S+$"))
    return F.struct(
        url.alias("url"),
        F.substring(F.try_element_at(rest, F.lit(1)), 1, 300).alias("title"),
        F.regexp_replace(F.try_element_at(company, F.lit(1)), r"(?i)^(company|empresa)\s*:\s*", "").alias("company"),
        F.array_join(F.slice(rest, 2, F.greatest(F.size(rest), F.lit(1))), "\n").alias("body"),
    )
