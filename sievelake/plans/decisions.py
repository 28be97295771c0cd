"""Decision queries: actions, checklists, assignment, states, mentions, signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievelake.functions import injection
from sievelake.operators import decisions, matching
from sievelake.operators.core import micros
from sievelake.plans.registry import query

_THRESHOLDS = {"save": 4.0, "apply": 6.5, "tailor": 8.0}


@query("""WITH s AS (SELECT o_orderkey, o_totalprice / 40000 - CASE WHEN o_orderpriority = '5-LOW' THEN 0.5 ELSE 0 END - CASE WHEN o_custkey % 3 = 0 THEN 1.0 ELSE 0 END AS raw, o_orderstatus, o_custkey FROM orders),
  c AS (SELECT o_orderkey, o_orderstatus, greatest(0.0, least(10.0, CASE WHEN o_custkey % 10 = 0 THEN least(raw, 5.0) ELSE raw END)) AS score FROM s)
  SELECT o_orderkey, CAST(floor(score * 100 + 0.5) AS BIGINT) AS cents, CASE WHEN o_orderstatus = 'P' THEN 'discard' WHEN score >= 8 THEN 'tailor' WHEN score >= 6.5 THEN 'apply' WHEN score >= 4 THEN 'save' ELSE 'discard' END AS action FROM c""")
def decide_actions(t):
    blockers = F.when(F.col("o_orderstatus") == "P", F.array(F.lit("closed"))).otherwise(F.array().cast("array<string>"))
    got = decisions.decide(
        F.col("o_totalprice") / 40000,
        [(F.col("o_custkey") % 10 == 0, 5.0)],
        [(F.col("o_orderpriority") == "5-LOW", 0.5), (F.col("o_custkey") % 3 == 0, 1.0)],
        blockers,
        _THRESHOLDS,
    )
    d = t.orders.select("o_orderkey", got.alias("d"))
    return d.select("o_orderkey", F.floor(F.col("d.score") * 100 + 0.5).cast("long").alias("cents"), F.col("d.action").alias("action"))


@query("""WITH c AS (SELECT doc_id, CASE WHEN lang IS NULL THEN NULL ELSE lang IN ('en', 'es') END AS a, CASE WHEN n_chars < 50 THEN NULL ELSE n_chars >= 500 END AS b, source <> 'src3' AS d FROM documents)
  SELECT doc_id, CAST((coalesce(a, false))::INT + (coalesce(b, false))::INT + d::INT AS INT) AS met, CAST((coalesce(NOT a, false))::INT + (coalesce(NOT b, false))::INT + (NOT d)::INT AS INT) AS not_met, CAST((a IS NULL)::INT + (b IS NULL)::INT AS INT) AS unknown, coalesce(NOT a, false) AS blocked FROM c""")
def checklist_items(t):
    items = [("language", F.col("lang").isin("en", "es"), True), ("length", F.when(F.col("n_chars") >= 50, F.col("n_chars") >= 500), False), ("source", F.col("source") != "src3", False)]
    return t.documents.select("doc_id", decisions.checklist_counts(decisions.checklist(items)).alias("c")).select("doc_id", "c.*")


@query("""WITH used AS (SELECT user_id AS o_custkey, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1),
  r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS position FROM orders)
  SELECT o_custkey, o_orderkey, position FROM r LEFT JOIN used USING (o_custkey) WHERE position <= 12 - coalesce(n, 0)""")
def daily_assignment(t):
    used = t.events.where("event_type = 'purchase'").groupBy(F.col("user_id").alias("o_custkey")).agg(F.count("*").alias("n"))
    rows = decisions.assign(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), used, "o_custkey", 12, F.desc("o_totalprice"), F.asc("o_orderkey"))
    return rows.select("o_custkey", "o_orderkey", "position")


@query("""SELECT o_orderkey, CASE o_orderstatus || l_returnflag WHEN 'OA' THEN 'A' WHEN 'OR' THEN 'R' WHEN 'PA' THEN 'A' ELSE o_orderstatus END AS next, o_orderstatus || l_returnflag IN ('OA', 'OR', 'PA') AS valid
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 1""")
def status_transitions(t):
    first = t.lineitem.where("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("event"))
    rows = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("status")).join(first, "o_orderkey")
    return decisions.next_state(rows, {("O", "A"): "A", ("O", "R"): "R", ("P", "A"): "A"}).select("o_orderkey", "next", "valid")


@query("""WITH last AS (SELECT * FROM (SELECT o_custkey, o_orderstatus, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1)
  SELECT c_custkey, CASE WHEN o_custkey IS NULL THEN 'no_previous' WHEN o_orderstatus <> 'F' THEN 'status' WHEN o_orderpriority <> '1-URGENT' THEN 'priority' ELSE 'ok' END AS reason FROM customer LEFT JOIN last ON o_custkey = c_custkey""")
def reuse_reasons(t):
    old = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.struct(micros("o_orderdate"), "o_orderkey").alias("at"))
    new = t.customer.select("c_custkey", F.lit("F").alias("status"), F.lit("1-URGENT").alias("priority"))
    return decisions.reusable(new, old, "c_custkey", ["status", "priority"], "at")



@query()
def skill_mentions(t):
    taxonomy = [("the", ["the"]), ("tion", ["tion and", "tion"]), ("der_die", ["der die", "der"]), ("le_la", ["le", "la"]), ("trash", ["trash"])]
    return matching.mentions(t.documents, taxonomy)


@query()
def injection_signals(t):
    return t.documents.select("doc_id", injection.injection_signals(F.col("text")).alias("signals"))
