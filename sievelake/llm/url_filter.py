"""URL filtering: a host/path rule list, then association rules mined from labelled URLs with FP-growth.

Mining: the frequent tokens of each labelled URL, and the item ``label:block`` for a bad one, are a transaction; tokens that never
occur apart are one item, so that a long URL with many copies has few combinations. FP-growth finds token combinations; a combination becomes a rule if it implies the label with enough
support, confidence and lift and no part of it does so as surely. Matching: an inverted index lists each
rule under its rarest token, so a URL meets only rules that share that token, and whole combinations are
then compared. Everything is a Spark expression or a Spark ML job in the JVM.
"""

from __future__ import annotations

import string

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.llm._session import checkpoint

LABEL = "label:block"
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if null or without ``://``."""
    host = F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"\A([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty if null or without ``://``."""
    return F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"\A[^/?#]*([^?#]*)", 1)


def tokens_of(url: Column) -> Column:
    """Distinct tokens: host labels, the last two labels, path segments (digits as one token), query keys."""
    host, path = host_of(url), F.lower(path_of(url))
    query = F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"\A[^?#]*\?([^#]*)", 1)
    some = lambda parts: F.filter(parts, lambda x: x != "")
    labels = some(F.split(host, r"\."))
    site = F.when(F.size(labels) >= 2, F.array(F.concat(F.lit("site:"), F.array_join(F.slice(labels, -2, 2), ".")))).otherwise(
        F.array().cast("array<string>")
    )
    segments = F.transform(some(F.split(path, "/")), lambda x: F.regexp_replace(x, r"\d+", "0"))
    keys = F.transform(some(F.split(query, "&")), lambda x: F.element_at(F.split(x, "="), 1))
    named = lambda kind, parts: F.transform(parts, lambda x: F.concat(F.lit(kind), x))
    return F.array_distinct(F.concat(named("host:", labels), site, named("path:", segments), named("key:", some(keys))))


def listed_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest listed rule that fits, else nulls. ``rules``: (verdict, ``host/path``) pairs."""
    rule = verdict = F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        site, slash, rest = text.partition("/")
        fits = ((host == site) | host.endswith("." + site)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def page_labels(pages: DataFrame, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, bad) of the pages whose document is labelled: the last number of a path names the document, which the page must really hold
    (the start of its first line stands in the HTML). Bad is quality 0. Pages without such a document or label have no row."""
    number = F.try_to_number(F.nullif(F.regexp_extract(path_of(F.col("url")), r"(\d{1,18})(?:\.\w+)?/?\z", 1), F.lit("")), F.lit("9" * 18)).cast("long")
    known = labels.where(F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc")).agg(F.min("quality").alias("quality"))
    line = F.substring(F.element_at(F.split(F.ltrim("text"), "\n"), 1), 1, 40)
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        line = F.replace(line, F.lit(char), F.lit(entity))
    starts = docs.select(F.col("doc_id").cast("long").alias("doc"), line.alias("line")).where(F.col("line") != "").join(known, "doc")
    named = pages.select("url", "html", number.alias("doc")).where(F.col("doc").isNotNull())
    return named.join(starts, "doc").where(F.contains("html", F.col("line"))).select("url", (F.col("quality") == 0).alias("bad"))


def mine(labelled: DataFrame, min_support: float = 0.002, min_count: int = 5, min_confidence: float = 0.6, min_lift: float = 1.5) -> DataFrame:
    """Rules (antecedent, confidence, key) from ``labelled`` (url, bad boolean); none for an empty table.

    Rows with a null url or label are left out; repeated rows count each; other columns may have any names. A rule needs ``min_count`` rows and a share
    of ``min_support`` of them that have all its tokens and the label. ``key`` is the rule's rarest token, the first of equally rare ones.
    """
    none = labelled.sparkSession.createDataFrame([], "antecedent array<string>, confidence double, key string")
    known = labelled.where(F.col("url").isNotNull() & F.col("bad").isNotNull())
    known = checkpoint(known.select(F.monotonically_increasing_id().alias("row"), "bad", tokens_of(F.col("url")).alias("tokens")))
    n = known.count()
    if not n:
        return none
    least = max(min_support * n, min_count)
    tokens = known.select("row", F.explode("tokens").alias("token"))
    rows_of = [F.count("*").alias("freq"), F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("y")]
    stats = tokens.groupBy("token").agg(*rows_of).where(F.col("freq") >= least)
    # tokens of equal rows are one item, named by the first of them; frequent tokens number a row's tokens over min_support at most
    classes = checkpoint(stats.groupBy("freq", "x", "y").agg(F.array_sort(F.collect_list("token")).alias("members")).select(F.col("members")[0].alias("item"), "members", "freq"))
    item_of = F.broadcast(classes.select(F.explode("members").alias("token"), "item"))
    items = tokens.join(item_of, "token").groupBy("row").agg(F.collect_set("item").alias("items"))
    baskets = known.join(items, "row", "left").select("bad", F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    baskets = checkpoint(baskets.select(F.when(F.col("bad"), F.array_append("items", F.lit(LABEL))).otherwise(F.col("items")).alias("items")))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, least / n), minConfidence=min_confidence).fit(baskets)
    found = model.associationRules.where((F.col("consequent") == F.array(F.lit(LABEL))) & (F.col("lift") >= min_lift) & ~F.array_contains("antecedent", LABEL))
    found = found.select(F.array_sort("antecedent").alias("found"), F.explode("antecedent").alias("item"), "confidence").join(F.broadcast(classes), "item")
    rules = found.groupBy("found", "confidence").agg(F.array_sort(F.flatten(F.collect_list("members"))).alias("antecedent"), F.min_by("item", F.struct("freq", "item")).alias("key"))
    rules = checkpoint(rules.select("antecedent", "confidence", "key"))
    # a part of a rule has its key among the rule's tokens
    parts = rules.select("key", F.col("antecedent").alias("part"), F.col("confidence").alias("part_confidence"))
    whole = rules.select("antecedent", "confidence", F.explode("antecedent").alias("key"))
    redundant = whole.join(parts, "key").where(
        (F.size("part") < F.size("antecedent")) & (F.col("part_confidence") >= F.col("confidence")) & (F.size(F.array_except("part", "antecedent")) == 0)
    )
    return checkpoint(rules.join(redundant.select("antecedent").distinct(), "antecedent", "left_anti"))


def judge(pages: DataFrame, mined: DataFrame, id_col: str = "page_id", rules=RULES) -> DataFrame:
    """Every row of ``pages``: id, host, path, rule, verdict, n_matched (mined rules that fit), confidence (best).

    The listed rule decides where one fits, else the mined rules: block if any fits, allow if none does. A null or
    empty url has empty host and path and is allowed. URLs of any length are read whole; repeated rows stay; extra columns are not carried; an empty
    table gives no rows.
    """
    urls = pages.select("url").where(F.col("url").isNotNull()).distinct().withColumn("tokens", tokens_of(F.col("url")))
    met = urls.select("url", "tokens", F.explode("tokens").alias("key")).join(mined, "key")
    met = met.where(F.size(F.array_except("antecedent", "tokens")) == 0)
    best = met.groupBy("url").agg(F.count("*").alias("n_matched"), F.max("confidence").alias("confidence"))
    rows = pages.select(F.col(id_col), "url").join(best, "url", "left")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = listed_rule(F.col("host"), F.col("path"), rules)
    by_method = F.when(F.col("n_matched") > 0, "block").otherwise("allow")
    rows = rows.withColumns({"host": host, "path": path}).withColumns({"rule": rule, "listed": verdict})
    return rows.select(
        id_col, "host", "path", "rule", F.coalesce("listed", by_method).alias("verdict"), F.coalesce("n_matched", F.lit(0)).alias("n_matched"), "confidence"
    )
