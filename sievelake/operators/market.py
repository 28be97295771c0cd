"""A career's market in one pass: all histograms of a set of postings, their shares and salary percentiles, from one grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fewer postings than this make a small sample; fewer informed salaries are not summed up.
SMALL_SAMPLE, ENOUGH_SALARIES = 30, 10
_CELL = "struct<block:string,key:string,must:boolean,value:double>"


def _cell(block: str, key: Column | str, value: Column | None = None, must: Column | None = None, when: Column | None = None) -> Column:
    key = F.lit(key) if isinstance(key, str) else key.cast("string")
    none = F.lit(None)
    cell = F.struct(F.lit(block).alias("block"), key.alias("key"), (none if must is None else must).cast("boolean").alias("must"), (none if value is None else value).cast("double").alias("value"))
    return cell if when is None else F.when(when, cell)


def tri_state(scope: Column, allowed: Column) -> Column:
    """accepts, refuses or silent, of a location scope (any, places, unknown) and whether its places allow the country."""
    return F.when(scope.isNull() | (scope == "unknown"), "silent").when((scope == "any") | F.coalesce(allowed, F.lit(False)), "accepts").otherwise("refuses")


def career_market(postings: DataFrame, now: Column, top_skills: int = 10) -> DataFrame:
    """(role, block, key, n, must, share, informed, p25, median, p75, small_sample): every block of every role.

    ``postings``: role, seniority, written (language), asks (boolean), english (level), modality, from_country (see ``tri_state``), source, published, local (boolean), salary (monthly, or null),
    skills (array<struct<slug, is_must>>). Each posting becomes one row for each block that it falls in, and all blocks are counted by one grouping, combined before the
    shuffle: the table is read once. A skill counts once in a posting, as a must if any mention is one. Nulls of a block are ``unknown``; ``share`` is of the role's postings. Salary
    percentiles stand apart for local and international postings, each with enough of them. Of skills the ``top_skills`` most named stay. Null roles are a role of their own.
    """
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("published").cast("timestamp"))
    day = 86_400_000_000
    or_unknown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    segment = F.when(F.coalesce("local", F.lit(False)), "local").otherwise("international")
    spanish = F.coalesce(F.col("written") == "es", F.lit(False))
    cells = [
        _cell("total", "all"),
        _cell("seniority", or_unknown("seniority")),
        _cell("written", or_unknown("written")),
        _cell("asks_english", F.coalesce("english", F.lit("no_level")), when=F.coalesce("asks", F.lit(False))),
        _cell("modality", or_unknown("modality")),
        _cell("from_country", F.coalesce("from_country", F.lit("silent"))),
        _cell("source", or_unknown("source")),
        _cell("fresh", "24h", when=age <= day),
        _cell("fresh", "7d", when=age <= 7 * day),
        _cell("fresh", "7d_spanish", when=(age <= 7 * day) & spanish),
        _cell("salary", segment, F.col("salary")),
        _cell("salary", F.concat_ws("/", segment, or_unknown("seniority")), F.col("salary")),
    ]
    skills = F.coalesce("skills", F.array().cast("array<struct<slug:string,is_must:boolean>>"))
    is_must = lambda slug: F.exists(skills, lambda s: (s["slug"] == slug) & F.coalesce(s["is_must"], F.lit(False)))
    slugs = F.array_compact(F.array_distinct(F.transform(skills, lambda s: s["slug"])))
    named = F.transform(slugs, lambda s: F.struct(F.lit("skill").alias("block"), s.alias("key"), is_must(s).alias("must"), F.lit(None).cast("double").alias("value")))
    rows = postings.select("role", F.explode(F.concat(F.array_compact(F.array(*[c.cast(_CELL) for c in cells])), named.cast(f"array<{_CELL}>"))).alias("c")).select("role", "c.*")
    got = rows.groupBy("role", "block", "key").agg(F.count("*").alias("n"), F.count_if("must").alias("must"), F.count("value").alias("informed"), F.percentile("value", [0.25, 0.5, 0.75]).alias("p"))
    # from here on there are as many rows as blocks
    of_role, of_skills = Window.partitionBy("role"), Window.partitionBy("role", "block").orderBy(F.desc("n"), F.desc("must"), "key")
    total = F.max(F.when(F.col("block") == "total", F.col("n"))).over(of_role)
    got = got.withColumn("total", total).withColumn("place", F.row_number().over(of_skills)).where((F.col("block") != "skill") | (F.col("place") <= top_skills))
    percentiles = [F.when((F.col("block") == "salary") & (F.col("informed") >= ENOUGH_SALARIES), F.round(F.col("p")[k], 4)).alias(c) for k, c in enumerate(("p25", "median", "p75"))]
    return got.select("role", "block", "key", "n", F.when(F.col("block") == "skill", F.col("must")).alias("must"), (F.col("n") / F.col("total")).alias("share"), F.when(F.col("block") == "salary", F.col("informed")).alias("informed"), *percentiles, (F.col("total") < SMALL_SAMPLE).alias("small_sample"))
