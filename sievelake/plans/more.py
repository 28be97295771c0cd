"""More reports and rankings: reveal counts, funnels with conversion, coverage by window, orderings, queues, bursts, planning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievelake.operators import decisions
from sievelake.operators.core import micros
from sievelake.plans.registry import query
from sievelake.sources import boards
from sievelake.streaming import jobs


@query("""WITH c AS (SELECT c_mktsegment AS role, count(*) AS received, CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS active FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment <> 'BUILDING' GROUP BY 1),
  h AS (SELECT unnest(['BUILDING', 'MACHINERY', 'HOUSEHOLD', 'NONE']) AS role) SELECT h.role, coalesce(received, 0) AS received, coalesce(active, 0) AS active, coalesce(received, 0) >= 300 AS ready, greatest(0, 300 - coalesce(received, 0)) AS missing,
  row_number() OVER (ORDER BY coalesce(received, 0) >= 300 DESC, coalesce(received, 0) DESC, h.role) AS position FROM h LEFT JOIN c USING (role)""")
def career_reveal(t):
    """Which hidden roles have enough postings to be shown, and how many the others lack."""
    rows = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).where("c_mktsegment <> 'BUILDING'")
    counts = rows.groupBy(F.col("c_mktsegment").alias("role")).agg(F.count("*").alias("received"), F.count_if(F.col("o_orderstatus") == "O").alias("active"))
    hidden = t.spark.createDataFrame([(r,) for r in ("BUILDING", "MACHINERY", "HOUSEHOLD", "NONE")], "role string")
    n = F.coalesce("received", F.lit(0))
    out = hidden.join(counts, "role", "left").select("role", n.alias("received"), F.coalesce("active", F.lit(0)).alias("active"), (n >= 300).alias("ready"), F.greatest(F.lit(0), 300 - n).alias("missing"))
    return out.withColumn("position", F.row_number().over(Window.orderBy(F.desc("ready"), F.desc("received"), "role")))


@query("""WITH h AS (SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS views, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS purchases FROM events GROUP BY 1)
  SELECT hour, views, purchases, CASE WHEN views > 0 THEN CAST(purchases AS DOUBLE) / views ELSE 0 END AS conversion, row_number() OVER (ORDER BY views DESC, hour) = 1 AS is_peak, CAST(sum(views) OVER () AS BIGINT) AS all_views, CAST(sum(purchases) OVER () AS BIGINT) AS all_purchases FROM h""")
def funnel_with_peak(t):
    """The steps by hour, their conversion, the hour with most visits (the first of equals), and totals. The window is over one row for each hour."""
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    h = t.events.groupBy(F.date_format("ts", "yyyy-MM-dd HH").alias("hour")).agg(n("view").alias("views"), n("purchase").alias("purchases"))
    whole = Window.partitionBy(F.lit(0))
    conversion = F.when(F.col("views") > 0, F.col("purchases") / F.col("views")).otherwise(0.0)
    peak = F.row_number().over(whole.orderBy(F.desc("views"), "hour")) == 1
    return h.withColumns({"conversion": conversion, "is_peak": peak, "all_views": F.sum("views").over(whole), "all_purchases": F.sum("purchases").over(whole)})


@query("""WITH now AS (SELECT max(o_orderdate) AS latest FROM orders) SELECT c_mktsegment AS role, o_orderstatus AS source, CAST(sum(CASE WHEN o_orderdate >= latest - INTERVAL 7 DAY THEN 1 ELSE 0 END) AS BIGINT) AS active_7, CAST(sum(CASE WHEN o_orderdate >= latest - INTERVAL 30 DAY THEN 1 ELSE 0 END) AS BIGINT) AS active_30,
  CAST(sum(CASE WHEN o_orderdate >= latest - INTERVAL 30 DAY AND o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS BIGINT) AS urgent_30, sum(CASE WHEN o_orderdate >= latest - INTERVAL 30 DAY THEN 1 ELSE 0 END) < 5 AS low FROM orders JOIN customer ON c_custkey = o_custkey, now GROUP BY 1, 2""")
def coverage_by_window(t):
    """Active in 7 and 30 days by role and source, from one pass with conditional counts."""
    rows = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).join(F.broadcast(t.orders.agg(F.max("o_orderdate").alias("at"))))
    within = lambda days: F.col("o_orderdate") >= F.col("at") - F.make_dt_interval(F.lit(days))
    g = rows.groupBy(F.col("c_mktsegment").alias("role"), F.col("o_orderstatus").alias("source"))
    return g.agg(F.count_if(within(7)).alias("active_7"), F.count_if(within(30)).alias("active_30"), F.count_if(within(30) & (F.col("o_orderpriority") == "1-URGENT")).alias("urgent_30")).withColumn("low", F.col("active_30") < 5)


@query("""WITH d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, user_id, count(*) AS turns, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) > 0 AS failed FROM events GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY turns) AS rn, count(*) OVER (PARTITION BY day) AS n FROM d)
  SELECT day, count(*) AS conversations, CAST(sum(turns) AS BIGINT) AS turns, max(turns) AS longest, max(CASE WHEN rn = greatest(1, CAST(ceil(n * 0.9) AS BIGINT)) THEN turns END) AS p90_turns, CAST(sum(CASE WHEN failed THEN 1 ELSE 0 END) AS BIGINT) AS failed FROM r GROUP BY 1""")
def conversations_by_day(t):
    """Each user's day is a conversation; per day their number, length and nearest-rank p90."""
    d = t.events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "user_id").agg(F.count("*").alias("turns"), F.bool_or(F.col("event_type") == "error").alias("failed"))
    p90 = F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY turns)").cast("long")
    return d.groupBy("day").agg(F.count("*").alias("conversations"), F.sum("turns").alias("turns"), F.max("turns").alias("longest"), p90.alias("p90_turns"), F.count_if("failed").alias("failed"))


@query("""WITH a AS (SELECT strftime(ts, '%Y-%m') AS month, user_id AS person FROM events WHERE event_type = 'purchase' UNION ALL SELECT strftime(ts, '%Y-%m'), user_id FROM events WHERE event_type = 'error' UNION ALL SELECT strftime(o_orderdate, '%Y-%m'), o_custkey FROM orders)
  SELECT month, count(*) AS activities, count(DISTINCT person) AS people FROM a GROUP BY 1""")
def activity_union(t):
    """Streams of activity put together, then distinct people."""
    e = lambda kind: t.events.where(F.col("event_type") == kind).select(F.date_format("ts", "yyyy-MM").alias("month"), F.col("user_id").alias("person"))
    o = t.orders.select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_custkey").alias("person"))
    return reduce(DataFrame.unionByName, [e("purchase"), e("error"), o]).groupBy("month").agg(F.count("*").alias("activities"), F.count_distinct("person").alias("people"))


_LIST = "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS score, o_orderkey % 3 AS blockers, o_orderkey % 5 AS risks, o_orderdate, o_orderstatus = 'P' AS evaluating FROM orders"


def _listed(t):
    score = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice"))
    return t.orders.select("o_orderkey", score.alias("score"), (F.col("o_orderkey") % 3).alias("blockers"), (F.col("o_orderkey") % 5).alias("risks"), "o_orderdate", (F.col("o_orderstatus") == "P").alias("evaluating"))


@query(f"SELECT o_orderkey, row_number() OVER (ORDER BY evaluating DESC, score DESC NULLS LAST, blockers, risks, o_orderdate DESC, o_orderkey) AS position FROM ({_LIST}) QUALIFY position <= 100")
def list_ordering(t):
    """The first hundred of the list: those being evaluated, then by score, blockers, risks and age."""
    order = [F.desc("evaluating"), F.desc_nulls_last("score"), F.asc("blockers"), F.asc("risks"), F.desc("o_orderdate"), F.asc("o_orderkey")]
    first = _listed(t).orderBy(*order).limit(100)
    # a hundred rows
    return first.select("o_orderkey", F.row_number().over(Window.orderBy(*order)).alias("position"))


@query(f"""WITH r AS (SELECT *, coalesce(score < 60000, false) AS far FROM ({_LIST})), n AS (SELECT o_orderkey, far, lag(o_orderkey) OVER w AS previous, lead(o_orderkey) OVER w AS next FROM r WINDOW w AS (PARTITION BY o_orderkey % 50, far ORDER BY score DESC NULLS LAST, blockers, risks, o_orderkey)) SELECT * FROM n""")
def neighbors_near_and_far(t):
    """Neighbours in each person's list, near and far apart; a row without a score is near."""
    rows = _listed(t).withColumn("far", F.coalesce(F.col("score") < 60000, F.lit(False))).withColumn("person", F.col("o_orderkey") % 50)
    w = Window.partitionBy("person", "far").orderBy(F.desc_nulls_last("score"), "blockers", "risks", "o_orderkey")
    return rows.select("o_orderkey", "far", F.lag("o_orderkey").over(w).alias("previous"), F.lead("o_orderkey").over(w).alias("next"))


@query("""WITH now AS (SELECT max(o_orderdate) - INTERVAL 30 DAY AS at FROM orders) SELECT o_orderkey, strftime(least(o_orderdate, now.at), '%Y-%m-%d') AS shown FROM orders, now ORDER BY least(o_orderdate, now.at) DESC, o_orderkey DESC LIMIT 50""")
def newest_clamped(t):
    """The newest by publication date; a date after now counts as now."""
    now = t.orders.agg((F.max("o_orderdate") - F.make_dt_interval(F.lit(30))).alias("at"))
    rows = t.orders.join(F.broadcast(now)).select("o_orderkey", F.least("o_orderdate", "at").alias("d"))
    return rows.orderBy(F.desc("d"), F.desc("o_orderkey")).limit(50).select("o_orderkey", F.date_format("d", "yyyy-MM-dd").alias("shown"))


@query("""WITH j AS (SELECT o_orderkey, unnest(string_split(o_orderpriority, '-')) AS hint FROM orders) SELECT hint, count(*) AS n, count(DISTINCT o_orderkey) AS postings FROM j GROUP BY 1""")
def exploded_hints(t):
    """A row for each hint of a posting, grouped by it."""
    rows = t.orders.select("o_orderkey", F.explode(F.split("o_orderpriority", "-")).alias("hint"))
    return rows.groupBy("hint").agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("postings"))


@query("""SELECT n_nationkey, count(event_id) AS tasks FROM nation LEFT JOIN events ON CAST(json_extract_string(props, '$.k') AS BIGINT) = n_nationkey AND event_type = 'click' GROUP BY 1""")
def joined_on_json_key(t):
    """Tasks whose payload names the row: the key is read from JSON once and joined like a column."""
    tasks = t.events.where("event_type = 'click'").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("n_nationkey")).where("n_nationkey is not null")
    n = tasks.groupBy("n_nationkey").agg(F.count("*").alias("tasks"))
    return t.nation.select(F.col("n_nationkey").cast("long").alias("n_nationkey")).join(n, "n_nationkey", "left").select("n_nationkey", F.coalesce("tasks", F.lit(0)).alias("tasks"))


@query("""WITH r AS (SELECT event_id, epoch_us(ts) AS micro, epoch_us(ts) // 60000000 AS minute, coalesce(CASE WHEN user_id % 9 = 0 THEN NULL ELSE CAST(user_id % 40 AS VARCHAR) END, 'none') AS key, 'm' || (event_id % 700) AS email FROM events),
  m AS (SELECT minute, count(*) AS n FROM r GROUP BY 1), w AS (SELECT minute, coalesce(sum(n) OVER (ORDER BY minute RANGE BETWEEN 10 PRECEDING AND 1 PRECEDING), 0) AS ten, coalesce(sum(n) OVER (ORDER BY minute RANGE BETWEEN 1440 PRECEDING AND 1 PRECEDING), 0) AS day FROM m),
  o AS (SELECT *, count(*) OVER (PARTITION BY key ORDER BY micro RANGE BETWEEN 3600000000 PRECEDING AND 1 PRECEDING) AS own, row_number() OVER (PARTITION BY email ORDER BY micro, event_id) AS rn FROM r)
  SELECT event_id AS id, CASE WHEN own >= 3 OR ten >= 6 OR day >= 420 THEN 'rate_limited' WHEN rn > 1 THEN 'duplicate' ELSE 'ok' END AS verdict FROM o JOIN w USING (minute)""")
def signup_bursts(t):
    key = F.when(F.col("user_id") % 9 != 0, (F.col("user_id") % 40).cast("string"))
    rows = t.events.select(F.col("event_id").alias("id"), "ts", key.alias("key"), F.concat(F.lit("m"), (F.col("event_id") % 700).cast("string")).alias("email"))
    return jobs.burst_limits(rows, per_key=3, burst=6, per_day=420)


@query("""WITH RECURSIVE e AS MATERIALIZED (SELECT user_id AS task, epoch_us(CAST(ts AS TIMESTAMP)) // 1000000 AS now, event_type AS kind, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(CAST(ts AS TIMESTAMP)) // 1000000, event_id) AS k FROM events),
  s AS (SELECT task, k, 'pending' AS status, 0 AS attempts, now AS due, CAST(NULL AS BIGINT) AS locked FROM e WHERE k = 1
  UNION ALL SELECT task, k, CASE WHEN takes THEN 'processing' WHEN status <> 'processing' THEN status WHEN kind = 'purchase' THEN 'done' WHEN kind = 'error' THEN CASE WHEN attempts >= 3 THEN 'failed' ELSE 'pending' END WHEN kind = 'signup' OR stale THEN 'pending' ELSE status END,
    attempts + takes::INT - (status = 'processing' AND kind = 'signup')::INT, CASE WHEN status = 'processing' AND kind = 'error' AND attempts < 3 THEN now + least(3600, 60 * CAST(pow(2, attempts - 1) AS BIGINT)) WHEN status = 'processing' AND kind = 'signup' THEN now ELSE due END,
    CASE WHEN takes THEN now WHEN status = 'processing' AND (kind = 'click' OR kind = 'view' AND NOT stale) THEN locked END
    FROM (SELECT s.task, e.k, s.status, s.attempts, s.due, s.locked, e.now, e.kind, e.kind = 'click' AND s.status = 'pending' AND s.due <= e.now AS takes, e.kind = 'view' AND coalesce(e.now - s.locked > 900, false) AS stale FROM s JOIN e ON e.task = s.task AND e.k = s.k + 1))
  SELECT task, status, CAST(attempts AS BIGINT) AS attempts, due AS run_after_s, locked AS locked_s FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY k DESC) AS rn FROM s) WHERE rn = 1""")
def queue_log_states(t):
    """Each user is a task: their first event enqueues it, then click takes it, purchase, error and signup answer, and view looks whether the lease is over."""
    first = F.row_number().over(Window.partitionBy("user_id").orderBy(F.unix_seconds(F.col("ts").cast("timestamp")), "event_id")) == 1
    kind = F.col("event_type")
    event = F.when(first, "enqueue").when(kind == "click", "dequeue").when(kind == "purchase", "ack").when(kind == "error", "fail").when(kind == "signup", "release").otherwise("stale")
    return jobs.queue_states(t.events.select(F.col("user_id").alias("task"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at_s"), F.col("event_id").alias("seq"), event.alias("event")))


@query("""WITH s AS (SELECT s_name AS source, 60 * (1 + s_nationkey % 5) AS minimum, CASE WHEN s_suppkey % 9 > 0 THEN s_suppkey * 37 % 1000 END AS last, CASE WHEN s_suppkey % 4 = 0 THEN 'http_429' WHEN s_suppkey % 4 = 1 THEN 'http_500' END AS error, 1 + s_suppkey % 3 AS cost FROM supplier),
  r AS (SELECT source, row_number() OVER w AS position, sum(cost) OVER w AS spent FROM s WHERE last IS NULL OR 1000 - last >= CASE WHEN error = 'http_429' THEN 2 * minimum ELSE minimum END WINDOW w AS (ORDER BY last NULLS FIRST, source)) SELECT source, position FROM r WHERE spent <= 60""")
def sources_due(t):
    """Suppliers as sources. Never asked first; one that had too many requests waits twice as long; the budget ends the list."""
    key = F.col("s_suppkey")
    error = F.when(key % 4 == 0, "http_429").when(key % 4 == 1, "http_500")
    rows = t.supplier.select(F.col("s_name").alias("source"), (60 * (1 + F.col("s_nationkey") % 5)).alias("minimum"), F.when(key % 9 > 0, key * 37 % 1000).alias("last_attempt"), error.alias("last_error"), (1 + key % 3).alias("cost"))
    return boards.due_sources(rows, F.lit(1000), 60)


@query("""WITH w AS (SELECT p_brand AS role, CAST(substr(p_brand, 7) AS BIGINT) AS role_order, p_name AS keyword, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_name) - 1 AS place FROM part GROUP BY 1, 2, 3),
  k AS (SELECT role, keyword, row_number() OVER (ORDER BY place, role_order) - 1 AS k, count(*) OVER () AS n FROM w WHERE place < 3), p AS (SELECT role, keyword, ((k - 2 * least(20, n)) % n + n) % n AS position, n FROM k)
  SELECT position, role, keyword FROM p WHERE position < least(20, n)""")
def query_plan_slice(t):
    """Brands as roles and their most frequent names as keywords: three a role, twenty a run, the third run."""
    place = F.row_number().over(Window.partitionBy("role").orderBy(F.desc("n"), "keyword")) - 1
    words = t.part.groupBy(F.col("p_brand").alias("role"), F.col("p_name").alias("keyword")).agg(F.count("*").alias("n"))
    rows = words.select("role", F.substring("role", 7, 9).cast("long").alias("role_order"), place.alias("place"), "keyword")
    return boards.planned_queries(rows, per_role=3, per_run=20, rotation=2)


@query("""WITH c AS (SELECT doc_id, item FROM (SELECT doc_id, n_chars % 7 AS lost, 7 AS facts, n_chars % 4 AS repeated, 1 + n_chars % 9 AS questions, n_chars % 3 AS resolved, 3 AS issues, 1 + doc_id % 12 AS turns FROM documents) AS item) SELECT count(*) AS conversations, sum(item.lost) / CAST(sum(item.facts) AS DOUBLE) AS lost_rate,
  sum(item.repeated) / CAST(sum(item.questions) AS DOUBLE) AS repeated_rate, sum(item.resolved) / CAST(sum(item.issues) AS DOUBLE) AS resolved_rate, median(item.turns) AS turns_median, sum(item.lost) / CAST(sum(item.facts) AS DOUBLE) <= 0.05 AND sum(item.repeated) / CAST(sum(item.questions) AS DOUBLE) <= 0.1 AS good_enough FROM c""".replace("SELECT doc_id, item FROM (SELECT doc_id, ", "SELECT item FROM (SELECT "))
def coach_metrics(t):
    """Totals over conversations of a coach: shares of facts lost, questions repeated, issues resolved, and the median length."""
    c = t.documents.select((F.col("n_chars") % 7).alias("lost"), F.lit(7).alias("facts"), (F.col("n_chars") % 4).alias("repeated"), (1 + F.col("n_chars") % 9).alias("questions"), (F.col("n_chars") % 3).alias("resolved"), F.lit(3).alias("issues"), (1 + F.col("doc_id") % 12).alias("turns"))
    share = lambda a, b: F.try_divide(F.sum(a), F.sum(b))
    out = c.agg(F.count("*").alias("conversations"), share("lost", "facts").alias("lost_rate"), share("repeated", "questions").alias("repeated_rate"), share("resolved", "issues").alias("resolved_rate"), F.median("turns").alias("turns_median"))
    return out.withColumn("good_enough", (F.col("lost_rate") <= 0.05) & (F.col("repeated_rate") <= 0.1))


@query("""WITH s AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY 1, 2), o AS (SELECT *, coalesce(sum(n % 2) OVER (ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 AS odd FROM s)
  SELECT a AS o_orderstatus, b AS o_orderpriority, CAST((n + 1 - odd) // 2 AS BIGINT) AS dev, CAST(n - (n + 1 - odd) // 2 AS BIGINT) AS test FROM o""")
def split_by_strata(t):
    parts = decisions.stratified_split(t.orders, "o_orderkey", ["o_orderstatus", "o_orderpriority"], seed=7)
    n = lambda p: F.count_if(F.col("part") == p).alias(p)
    return t.orders.join(parts, "o_orderkey").groupBy("o_orderstatus", "o_orderpriority").agg(n("dev"), n("test"))


@query("""WITH old AS (SELECT l_orderkey AS posting, 'p' || (l_partkey % 20) AS skill FROM lineitem WHERE l_linenumber <= 2), new AS (SELECT l_orderkey AS posting, 'p' || (l_partkey % 20) AS skill FROM lineitem WHERE l_linenumber = 3),
  k AS (SELECT * FROM old WHERE posting NOT IN (SELECT posting FROM new) UNION SELECT * FROM new) SELECT skill, count(*) AS mentions FROM k GROUP BY 1""")
def mention_sync(t):
    """Mentions of re-read postings replace their old ones; others stay."""
    skill = F.concat(F.lit("p"), (F.col("l_partkey") % 20).cast("string")).alias("skill")
    rows = t.lineitem.select(F.col("l_orderkey").alias("posting"), skill, "l_linenumber")
    old, new = rows.where("l_linenumber <= 2").drop("l_linenumber").distinct(), rows.where("l_linenumber = 3").drop("l_linenumber").distinct()
    kept = old.join(new.select("posting").distinct(), "posting", "left_anti").unionByName(new)
    return kept.groupBy("skill").agg(F.count("*").alias("mentions"))


@query("""WITH d AS (SELECT event_type, user_id, count(*) AS n, max(epoch_us(ts)) AS last FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, last DESC, user_id) AS position FROM d)
  SELECT r.event_type, r.user_id, position, (SELECT max(value) FROM events e WHERE e.user_id = r.user_id AND e.event_type = r.event_type AND epoch_us(e.ts) = r.last) AS last_value FROM r WHERE position <= 5""")
def ranked_then_hydrated(t):
    """Ranks on narrow columns; wide rows of the winners are read afterwards, by a join with so few rows that they are broadcast."""
    at = micros("ts").alias("at")
    d = t.events.select("event_type", "user_id", at).groupBy("event_type", "user_id").agg(F.count("*").alias("n"), F.max("at").alias("last"))
    best = d.withColumn("position", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("n"), F.desc("last"), "user_id"))).where("position <= 5")
    wide = t.events.select("event_type", "user_id", at, "value").join(F.broadcast(best.select("event_type", "user_id", F.col("last").alias("at"), "position")), ["event_type", "user_id", "at"])
    return wide.groupBy("event_type", "user_id", "position").agg(F.max("value").alias("last_value"))
