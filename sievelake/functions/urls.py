"""URLs as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: query parameters that only track
TRACKING = (
    "fbclid", "gclid", "dclid", "msclkid", "mc_cid", "mc_eid", "_hsenc", "_hsmi", "hsctatracking", "ref", "refid", "trk", "trkinfo", "trackingid", "lipi", "licu", "li_fat_id",
    "refresh", "position", "pagenum", "origin", "originalsubdomain", "midtoken", "midsig", "otptoken", "ebp", "source", "src",
)


def canonical_url(raw: Column) -> Column:
    """http(s) only, else null: lower-case host without ``www.``, no fragment, tracking parameters or final slash, sorted query;
    a posting of linkedin.com by its number; of indeed.com's parameters only ``jk``. Percent escapes stay as they are."""
    url = F.trim(raw)
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z]+)://", 1))
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#:]+)", 1)), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1), "/+$", "")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    name = lambda p: F.lower(F.element_at(F.split(p, "="), 1))
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~name(p).isin(*TRACKING) & ~name(p).startswith("utm_"))
    kept = F.when(host.endswith("indeed.com"), F.filter(kept, lambda p: name(p) == "jk")).otherwise(kept)
    kept = F.array_sort(kept)
    plain = F.concat(scheme, F.lit("://"), host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))
    number = F.coalesce(
        F.nullif(F.regexp_extract(query, r"(?:^|&)currentJobId=(\d+)(?:&|$)", 1), F.lit("")),
        F.nullif(F.regexp_extract(path, r"/jobs/view/(?:[^/]*-)?(\d+)$", 1), F.lit("")),
    )
    linkedin = (host == "linkedin.com") | host.endswith(".linkedin.com")
    posting = F.concat(F.lit("https://linkedin.com/jobs/view/"), number)
    return F.when(scheme.isin("http", "https") & (host != ""), F.when(linkedin & number.isNotNull(), posting).otherwise(plain))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/?#:]*)", 1))


def base_domain(host: Column) -> Column:
    """The last two labels, or three where the last but one is a short second-level name (com, co, org, net, gob, gov, edu)."""
    labels = F.split(host, r"\.")
    second = F.try_element_at(labels, F.lit(-2))
    n = F.when(second.isin("com", "co", "org", "net", "gob", "gov", "edu"), 3).otherwise(2)
    return F.array_join(F.slice(labels, -F.least(n, F.size(labels)), n), ".")
