"""Candidates of all people at once: bounded top-k lists over an inverted role index, then the winners' wide rows.

A person's candidates are ordered by whether the title names one of their roles, whether a role of the posting is one of theirs, then newest first. Those flags
depend on the roles alone, so lists are made for roles, not for people: one for each (role that the title names or none, role of the posting or none),
by date alone. The best ``k`` of a set of roles stand among the best ``k`` of its lists: who stands before a posting in the list that has both its flags has
the same flags at least, and is newer. People with one set of roles share its list. What a person owns leaves runs of free positions in it, and only these runs
are dealt out: a person who owns nothing of the list is one row until the result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelake.session import checkpoint, ship

#: People who own more than this of the first postings of their list are searched for apart: else all lists would have to be as long.
MOST_OWNED = 1000
#: People of one set of roles that read one copy of its list; more are dealt over several.
_SHARING = 1024
#: Rows that a task gathers before it cuts them down to the best of each key.
_GATHERED = 1 << 18


def _best(table: pa.Table, keys: list[str], order: list[tuple[str, str]], k: int) -> pa.Table:
    table = table.sort_by([(c, "ascending") for c in keys] + order)
    n = len(table)
    if not n:
        return table
    new = np.zeros(n, dtype=bool)
    new[0] = True
    for c in keys:
        codes = table[c].combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    first = np.flatnonzero(new)
    place = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
    return table.filter(pa.array(place < k))


def top_k(df: DataFrame, keys: list[str], order: list[tuple[str, str]], k: int) -> DataFrame:
    """The first ``k`` rows of each key by ``order`` ((column, ascending or descending), total; nulls last), with ``position`` from 1.

    Each task keeps the best ``k`` of each key that it meets and drops the others as it goes, so a key that holds a third of all rows costs ``k`` rows for each
    task in the shuffle; the same cut then merges them. No key's rows are sorted or held together.
    """
    schema = df.schema
    ship(df.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, kept = [], 0, 0
        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows > _GATHERED + 2 * kept:
                table = _best(pa.Table.from_batches(held), keys, order, k)
                held, rows = table.to_batches(), len(table)
                kept = rows
        if held:
            yield from _best(pa.Table.from_batches(held), keys, order, k).to_batches()

    def last(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([c for c, _ in order], ascending=[way == "ascending" for _, way in order], na_position="last", kind="stable").head(k)
        return pdf.assign(position=np.arange(1, len(pdf) + 1))

    few = df.mapInArrow(cut, schema)
    return few.groupBy(*keys).applyInPandas(last, _with_position(schema))


def _with_position(schema) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields] + ["position long"])


def in_windows(now: Column, last_seen: Column, posted: Column, source: Column, boards: tuple[str, ...], seen_days: int = 14, posted_days: int = 30) -> Column:
    """A posting is alive: seen in the last ``seen_days``, and posted in the last ``posted_days``, or at an unknown time, or by one of ``boards``, which keep what is open."""
    day = 86_400_000_000
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    fresh = posted.isNull() | source.isin(*boards) | (micros(posted) >= micros(now) - posted_days * day)
    return F.coalesce((micros(last_seen) >= micros(now) - seen_days * day) & fresh, F.lit(False))


def owned_ids(owned: DataFrame, pool: DataFrame) -> DataFrame:
    """(user, id) of the pool's postings that people own, by pool id, by url or by content hash; nulls match nothing. One join for each key."""
    by = lambda theirs, ours: owned.select("user", theirs).where(F.col(theirs).isNotNull()).join(pool.select("id", F.col(ours).alias(theirs)).where(F.col(theirs).isNotNull()), theirs).select("user", "id")
    return by("url", "url").union(by("hash", "hash")).union(by("pool_id", "id_key")).distinct()


def role_index(pool: DataFrame, named: Column) -> DataFrame:
    """(strong, hint, id, posted): an entry for each role that the title names (``named``, array) or none, and each role of the posting's ``hints``. A posting without
    hints has the hint ``*``, as anyone may have it. Null stands for none."""
    strong = F.concat(F.array(F.lit(None).cast("string")), F.array_distinct(F.coalesce(named, F.array().cast("array<string>"))))
    hints = F.array_distinct(F.coalesce(F.col("hints"), F.array().cast("array<string>")))
    rows = pool.select("id", "posted", strong.alias("strongs"), F.when(F.size(hints) > 0, hints).otherwise(F.array(F.lit("*"))).alias("hints"))
    return rows.select("id", "posted", F.explode("strongs").alias("strong"), "hints").select("id", "posted", "strong", F.explode("hints").alias("hint"))


def _wanted(people: DataFrame, *carried: str) -> DataFrame:
    """(carried, strong, hint): the lists of the index that may hold candidates of a set of ``roles``."""
    own = people.select(*carried, F.explode(F.concat(F.array(F.lit(None).cast("string")), "roles")).alias("strong"), "roles")
    return own.select(*carried, "strong", F.explode(F.concat(F.array(F.lit("*")), "roles")).alias("hint"))


_RANK = [("strong", "descending"), ("exact", "descending"), ("posted", "descending"), ("id", "ascending")]


def _flagged(entries: DataFrame, *keys: str) -> DataFrame:
    """One row for each key and posting, with its best flags."""
    return entries.groupBy(*keys, "id", "posted").agg(F.max(F.col("strong").isNotNull().cast("int")).alias("strong"), F.max((F.col("hint") != "*").cast("int")).alias("exact"))


def _ranked(profiles: DataFrame, index: DataFrame, deep: int) -> DataFrame:
    """(profile, id, posted, strong, exact, position): the first ``deep`` postings of each of ``profiles`` (profile, roles)."""
    lists = top_k(index, ["strong", "hint"], [("posted", "descending"), ("id", "ascending")], deep).drop("position")
    wanted = _wanted(profiles, "profile")
    met = wanted.join(lists, _same(wanted, lists)).select("profile", lists["strong"], lists["hint"], "id", "posted")
    # a profile has no more than ``deep`` rows from each of its lists
    place = F.row_number().over(Window.partitionBy("profile").orderBy(F.desc("strong"), F.desc("exact"), F.desc_nulls_last("posted"), "id"))
    return _flagged(met, "profile").withColumn("position", place.cast("long")).where(F.col("position") <= deep)


def _runs(people: DataFrame, taken: DataFrame, deep: int, k: int) -> DataFrame:
    """(user, profile, lo, hi, owns): the runs of positions that hold a person's first ``k`` free ones, and how many owned ones stand before. ``taken``: (user, profile, position)."""
    each = Window.partitionBy("user").orderBy("position")
    places = people.select("user", "profile", F.lit(0).cast("long").alias("position")).unionByName(taken)
    runs = places.select("user", "profile", (F.col("position") + 1).alias("lo"), F.lead("position").over(each).alias("next"), (F.row_number().over(each) - 1).cast("long").alias("owns"))
    return runs.select("user", "profile", "lo", F.least(F.coalesce(F.col("next") - 1, F.lit(deep)), F.col("owns") + k).alias("hi"), "owns").where(F.col("lo") <= F.col("hi"))


def _dealt(runs: DataFrame, ranked: DataFrame, people: DataFrame) -> DataFrame:
    """``runs`` with the postings in them. The list of a set of roles that many people share is copied, a copy for each ``_SHARING`` of them, so that no task gets them all."""
    # a row for each ``_SHARING`` people at most
    shared = F.broadcast(people.groupBy("profile").agg(F.ceil(F.count("*") / _SHARING).cast("int").alias("copies")).where(F.col("copies") > 1))
    copies = F.coalesce("copies", F.lit(1))
    runs = runs.join(shared, "profile", "left").withColumn("copy", F.pmod(F.hash("user"), copies)).drop("copies")
    ranked = ranked.join(shared, "profile", "left").withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1))).drop("copies")
    return runs.join(ranked, ["profile", "copy"]).where(F.col("position").between(F.col("lo"), F.col("hi"))).withColumn("position", F.col("position") - F.col("owns"))


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["strong"].eqNullSafe(b["strong"]) & (a["hint"] == b["hint"])


def candidates(people: DataFrame, pool: DataFrame, owned: DataFrame, named: Column, k: int = 300, most_owned: int = MOST_OWNED, columns: Iterable[str] = ()) -> DataFrame:
    """(user, id, posted, strong, exact, position, columns): the first ``k`` postings that each of ``people`` (user, roles) doesn't own.

    ``pool`` (id, hints, posted, url, hash, and what ``named``, the roles that a title names, needs) holds what is alive and no copy. A posting is a candidate if one of
    its hints is one of the roles, or it has none. Order: title names a role, a hint is a role, newest (unknown last), id. Null users and people without roles get
    postings without hints only; a user with several rows has the roles of all. ``owned``: (user, pool_id, url, hash). Wide ``columns`` of the pool are read for
    the winners only, each once, before they are dealt out.

    Lists are as long as most people need, then longer for those who own too much of them; whoever owns more than ``most_owned`` of the longer ones goes through
    the index alone.
    """
    people = people.where(F.col("user").isNotNull()).groupBy("user").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("roles", F.array().cast("array<string>")))))).alias("roles"))
    rest = checkpoint(people.withColumn("roles", F.array_compact("roles")).withColumn("profile", F.to_json("roles")))
    index, found = role_index(pool, named), []
    given = ["user", "id", "posted", "strong", "exact", "position", *columns]
    for deep in sorted({min(2 * k, k + most_owned), k + most_owned}):
        ranked = checkpoint(_ranked(rest.select("profile", "roles").distinct(), index, deep))
        listed = checkpoint(pool.join(ranked.select("id").distinct(), "id", "left_semi").select("id", "url", "hash", F.col("id").alias("id_key")))
        taken = checkpoint(owned_ids(owned, listed).join(rest.select("user", "profile"), "user").join(ranked.select("profile", "id", "position"), ["profile", "id"]).select("user", "profile", "position"))
        # a list that is shorter than ``deep`` is whole
        cut = ranked.where(F.col("position") == deep).select("profile")
        short = checkpoint(taken.groupBy("user", "profile").agg(F.count("*").alias("n")).where(F.col("n") > deep - k).join(cut, "profile", "left_semi").select("user"))
        runs = checkpoint(_runs(rest, taken, deep, k).join(short, "user", "left_anti"))
        if columns:
            won = ranked.join(runs.select("profile", "lo", "hi").distinct(), "profile").where(F.col("position").between(F.col("lo"), F.col("hi")))
            ranked = checkpoint(hydrated(ranked.join(won.select("id").distinct(), "id", "left_semi"), pool, [*columns]))
        found.append(_dealt(runs, ranked, rest).select(given))
        rest = checkpoint(rest.join(short, "user", "left_semi"))
        if rest.isEmpty():
            break
    else:
        # those who own so much go through the index themselves, past what they own
        own = _wanted(rest, "user")
        direct = _flagged(own.join(index, _same(own, index)).select("user", index["strong"], index["hint"], "id", "posted"), "user")
        mine = owned_ids(owned.join(rest.select("user"), "user", "left_semi"), pool.withColumn("id_key", F.col("id")))
        left = checkpoint(top_k(direct.select("user", "id", "posted", "strong", "exact").join(mine, ["user", "id"], "left_anti"), ["user"], _RANK, k))
        found.append((hydrated(left, pool, [*columns]) if columns else left).select(given))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def hydrated(picked: DataFrame, pool: DataFrame, columns: list[str]) -> DataFrame:
    """``picked`` with wide ``columns`` of the pool: only rows of the winners are read from it, each once, then dealt out."""
    wide = pool.join(picked.select("id").distinct(), "id", "left_semi").select("id", *columns)
    return picked.join(wide, "id")
