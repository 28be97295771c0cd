"""Reproducible shuffle into shards: a Feistel permutation, with cycle walking, of global row numbers.

The place of a row is ``p = permute(row number)``; its shard is ``p mod shards`` and its slot ``p div shards``.
Both can be computed for any row number without looking at another row, shard sizes differ by one at
most (the law ``rows``), and slots have no gaps. Everything is a Spark expression.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.llm._rows import with_row_number

ROUNDS = 6
#: Cycle-walking steps at most. At most ``a - 1`` of the ``a * b`` places lie outside, with ``a`` about
#: sqrt(n): a second step is rare, and a row still outside afterwards raises an error.
WALK = 64


def sides(n: int) -> tuple[int, int]:
    """The radices (a, b) of the Feistel network: a * b >= n, with fewer than ``a`` places too many."""
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def permute(number: Column, n: int, seed: int) -> Column:
    """A bijection of 0 .. n-1. A number is split into two digits (radices ``sides(n)``); each round adds a
    keyed hash of one digit to the other; numbers outside are permuted again until they fall inside."""
    a, b = sides(n)
    keys = F.array(*[F.lit(i) for i in range(ROUNDS)])

    def one_round(digits: Column, key: Column) -> Column:
        left, right = digits["l"], digits["r"]
        even = F.pmod(left + F.pmod(F.xxhash64(F.lit(seed), key, right), F.lit(a)), F.lit(a))
        odd = F.pmod(right + F.pmod(F.xxhash64(F.lit(seed), key, left), F.lit(b)), F.lit(b))
        is_even = key % 2 == 0
        return F.struct(F.when(is_even, even).otherwise(left).alias("l"), F.when(is_even, right).otherwise(odd).alias("r"))

    def network(x: Column) -> Column:
        right = F.pmod(x, F.lit(b)).cast("long")
        # exact below 2**53, as row numbers are: the difference is a multiple of b
        start = F.struct(((x - right) / F.lit(b)).cast("long").alias("l"), right.alias("r"))
        return F.aggregate(keys, start, one_round, lambda d: d["l"] * F.lit(b) + d["r"])

    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK)), network(number), lambda x, _: F.when(x < F.lit(n), x).otherwise(network(x))
    )
    return F.when(walked < F.lit(n), walked).otherwise(F.raise_error(F.lit("cycle walking did not end")).cast("long"))


def shard(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, seed: int = 20) -> DataFrame:
    """Deals all rows into ``shards`` shards by the law ``rows``.

    Returns ``id_col``, size, text_crc32, law, shard, slot, grown_shard, and row_number, position. Row numbers follow
    (id, text checksum, size), nulls first; equal rows are interchangeable, so repeated rows and ties give a
    defined multiset of places. A null text has size 1 and checksum 0, as an empty one has. Extra columns are
    not carried. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = df.select(
        F.col(id_col),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
    )
    numbered, n = with_row_number(narrow, [id_col, "text_crc32", "size"])
    placed = numbered.withColumn("position", permute(F.col("row_number"), n, seed))
    return placed.select(
        id_col,
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.pmod("position", F.lit(shards)).cast("int").alias("shard"),
        F.floor(F.col("position") / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row_number",
        "position",
    )
