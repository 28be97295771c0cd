"""Transforms that many queries share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(at: Column | str) -> Column:
    """Microseconds since the epoch, of timestamps with or without a zone."""
    return F.unix_micros((F.col(at) if isinstance(at, str) else at).cast("timestamp"))


def latest_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key by ``order`` (which must be total). The struct minimum is combined before the shuffle, so
    a hot key costs one row for each map task, unlike a window."""
    names = [f"_o{k}" for k in range(len(order))]
    rest = [c for c in df.columns if c not in keys]
    best = F.min(F.struct(*[c.alias(n) for c, n in zip(order, names, strict=True)], F.struct(*rest).alias("_row")))
    return df.groupBy(*keys).agg(best.alias("_best")).select(*keys, "_best._row.*")


def top_n_per_group(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)


def anti_join_any(df: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that match ``known`` in none of ``keys``. One anti join for each key: a single one with OR would be a nested loop.
    Null keys never match."""
    for k in keys:
        df = df.join(known.select(k).where(F.col(k).isNotNull()).distinct(), k, "left_anti")
    return df


def with_exists(df: DataFrame, other: DataFrame, key: str, name: str) -> DataFrame:
    """Adds boolean ``name``: the key is in ``other``."""
    flags = other.select(key).distinct().withColumn(name, F.lit(True))
    return df.join(flags, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def weighted_demand(mentions: DataFrame, skill: str, score: str, must: str, optional_tenths: int = 4) -> DataFrame:
    """mentions, must_mentions and weighted_demand (two decimals) for each skill. ``score`` is in tenths (null: 50);
    optional mentions weigh ``optional_tenths`` / 10."""
    weight = F.coalesce(F.col(score), F.lit(50)) * F.when(F.col(must), 10).otherwise(optional_tenths)
    return mentions.groupBy(skill).agg(
        F.count("*").alias("mentions"),
        F.count_if(must).alias("must_mentions"),
        F.round(F.sum(weight) / 100, 2).alias("weighted_demand"),
    )


def suppress_small(df: DataFrame, people: str, columns: list[str], least: int = 3) -> DataFrame:
    """Numbers of groups of fewer than ``least`` people become null."""
    return df.withColumns({c: F.when(F.col(people) >= least, F.col(c)) for c in columns})


def first_match(rules: list[tuple[Column, str]], otherwise: str | None = None) -> Column:
    """The name of the first rule, in order, that holds."""
    out = F.lit(otherwise).cast("string")
    for holds, name in reversed(rules):
        out = F.when(holds, F.lit(name)).otherwise(out)
    return out


def merge_rows(old: DataFrame, new: DataFrame, keys: list[str], signature: list[str]) -> DataFrame:
    """The next state of a table: rows without news are ``kept``, rows whose ``signature`` is as before ``unchanged``, others ``updated`` as a whole, unknown
    keys ``inserted``; ``change`` tells which. ``new`` has the columns of ``old``, nulls anywhere; null keys meet null keys. Keys must be unique on either side."""
    rest = [c for c in old.columns if c not in keys]
    # each side as one struct: whether a side has the row is whether its struct is null, whatever its columns are
    side = lambda df, name: df.select(*[F.col(k).alias(f"_{name}{i}") for i, k in enumerate(keys)], F.struct(*rest).alias(name))
    o, n = side(old, "_old"), side(new, "_new")
    met = o.join(n, reduce(lambda x, y: x & y, [o[f"__old{i}"].eqNullSafe(n[f"__new{i}"]) for i in range(len(keys))]), "full")
    sign = lambda name: F.struct(*[F.col(f"{name}.{c}") for c in signature])
    has_old, has_new = F.col("_old").isNotNull(), F.col("_new").isNotNull()
    change = F.when(~has_new, "kept").when(~has_old, "inserted").when(sign("_old").eqNullSafe(sign("_new")), "unchanged").otherwise("updated")
    key = [F.when(has_new, F.col(f"__new{i}")).otherwise(F.col(f"__old{i}")).alias(k) for i, k in enumerate(keys)]
    return met.select(*key, *[F.when(has_new, F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}")).alias(c) for c in rest], change.alias("change"))


def round_half(x: Column) -> Column:
    """To the nearest half, up from the middle."""
    return F.floor(x * 2 + 0.5) / 2


def pre_score(coverage: Column, penalty: Column, cap: Column) -> Column:
    """3 + 6 x coverage (5 without one) less the penalty, capped, within 0 and 10, in half steps."""
    base = F.coalesce(3 + 6 * coverage, F.lit(5.0)) - F.coalesce(penalty, F.lit(0.0))
    return round_half(F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.least(base, cap))))


def plan_priority(demand: Column, level: Column, hours: Column) -> Column:
    """demand x (1 - level / 3) x ease; ease is 16 hours over ``hours`` within 0.1 and 1, a half if unknown."""
    ease = F.when(hours.isNull(), 0.5).when(hours <= 0, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.1), 16 / hours)))
    known = F.least(F.lit(3), F.greatest(F.lit(0), F.coalesce(level, F.lit(0))))
    return F.floor(demand * (1 - known / 3) * ease * 100 + 0.5) / 100
