"""Candidate selection over whole tables: customers choose among orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievelake.operators import selection
from sievelake.plans.registry import query

#: Postings kept for each person: the feature's own bound.
KEPT = 40
_NOW = "2001-08-01"
_BOARDS = ("P",)


def _pool(t):
    """Orders as postings: the priority is the title, the quarter and the customer's segment are roles."""
    o = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), F.lower("c_mktsegment").alias("segment")), "o_custkey")
    month = F.month("o_orderdate")
    hints = F.when(F.col("o_orderkey") % 4 == 0, F.array().cast("array<string>")).when(F.col("o_orderkey") % 3 == 0, F.array("segment", F.concat(F.lit("q"), F.quarter("o_orderdate").cast("string")))).otherwise(F.array("segment"))
    alive = selection.in_windows(F.lit(_NOW).cast("timestamp"), F.lit(_NOW).cast("timestamp") - F.make_dt_interval(days=(F.col("o_orderkey") % 20).cast("int")), F.col("o_orderdate"), F.col("o_orderstatus"), _BOARDS, 14, 1800)
    posted = F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderdate"))
    return o.where(alive & (F.col("o_orderkey") % 17 != 0)).select(
        F.col("o_orderkey").alias("id"), "o_orderpriority", hints.alias("hints"), posted.alias("posted"), F.concat(F.lit("u"), F.floor(F.col("o_orderkey") / 3).cast("string")).alias("url"), F.when(month > 3, F.col("o_totalprice").cast("string")).alias("hash"), "o_totalprice"
    )


_POOL_SQL = f"""p AS (SELECT o_orderkey AS id, o_orderpriority, CASE WHEN o_orderkey % 4 = 0 THEN CAST([] AS VARCHAR[]) WHEN o_orderkey % 3 = 0 THEN [lower(c_mktsegment), 'q' || quarter(o_orderdate)] ELSE [lower(c_mktsegment)] END AS hints,
  CASE WHEN o_orderkey % 13 <> 0 THEN o_orderdate END AS posted, 'u' || (o_orderkey // 3) AS url, CASE WHEN month(o_orderdate) > 3 THEN CAST(o_totalprice AS VARCHAR) END AS hash, o_totalprice
  FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 20 <= 14 AND o_orderkey % 17 <> 0 AND (o_orderstatus = 'P' OR o_orderdate >= TIMESTAMP '{_NOW}' - INTERVAL 1800 DAY)),
u AS (SELECT c_custkey AS "user", CASE WHEN c_custkey % 11 = 0 THEN CAST([] AS VARCHAR[]) WHEN c_custkey % 2 = 0 THEN [lower(c_mktsegment)] ELSE [lower(c_mktsegment), 'q' || (1 + c_custkey % 4)] END AS roles FROM customer),
w AS (SELECT user_id AS "user", event_id AS pool_id, 'u' || (event_id // 3) AS url FROM events WHERE event_type = 'click'),
m AS (SELECT u."user", u.roles, p.*, len(list_intersect(hints, roles)) > 0 AS exact, (list_contains(roles, 'building') AND o_orderpriority LIKE '1%') OR (list_contains(roles, 'q2') AND o_orderpriority LIKE '%HIGH%') AS strong
  FROM u JOIN p ON len(hints) = 0 OR len(list_intersect(hints, roles)) > 0
  WHERE NOT EXISTS (SELECT 1 FROM w WHERE w."user" = u."user" AND w.pool_id = p.id) AND NOT EXISTS (SELECT 1 FROM w WHERE w."user" = u."user" AND w.url = p.url)
    AND NOT EXISTS (SELECT 1 FROM w JOIN p AS q ON q.id = w.pool_id WHERE w."user" = u."user" AND q.hash = p.hash)),
k AS (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY strong DESC, exact DESC, posted DESC NULLS LAST, id) AS position FROM m)"""


def _people(t):
    segment = F.lower("c_mktsegment")
    roles = F.when(F.col("c_custkey") % 11 == 0, F.array().cast("array<string>")).when(F.col("c_custkey") % 2 == 0, F.array(segment)).otherwise(F.array(segment, F.concat(F.lit("q"), (1 + F.col("c_custkey") % 4).cast("string"))))
    return t.customer.select(F.col("c_custkey").alias("user"), roles.alias("roles"))


def _owned(t, pool):
    """People own what they clicked on: by id, by url, and by the content of what they own by id."""
    own = t.events.where("event_type = 'click'").select(F.col("user_id").alias("user"), F.col("event_id").alias("pool_id"), F.concat(F.lit("u"), F.floor(F.col("event_id") / 3).cast("string")).alias("url"))
    return own.join(pool.select(F.col("id").alias("pool_id"), "hash"), "pool_id", "left")


@query(f"""WITH {_POOL_SQL} SELECT "user", id, CAST(strong AS INT) AS strong, CAST(exact AS INT) AS exact, CAST(position AS BIGINT) AS position, o_totalprice FROM k WHERE position <= {KEPT}""")
def pool_candidates(t):
    """All customers at once; the price stands for the wide columns, read for winners only."""
    pool = _pool(t)
    named = F.array_compact(F.array(F.when(F.col("o_orderpriority").startswith("1"), "building"), F.when(F.col("o_orderpriority").contains("HIGH"), "q2")))
    return selection.candidates(_people(t), pool, _owned(t, pool), named, k=KEPT, columns=["o_totalprice"]).select("user", "id", "strong", "exact", "position", "o_totalprice")
