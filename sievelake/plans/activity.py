"""Event reports: funnels, spend, quotas, visits, anomalies, anonymous metrics, queue state."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sievelake.operators.core import merge_rows, micros, suppress_small, with_exists
from sievelake.plans.registry import query


def _cents():
    return F.floor(F.col("value") * 100 + 0.5).cast("long")


_DAY = lambda c="ts": F.date_format(c, "yyyy-MM-dd")
_CENTS_SQL = "CAST(floor(value * 100 + 0.5) AS BIGINT)"


@query(f"SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS calls, CAST(sum({_CENTS_SQL}) AS BIGINT) AS cents, CAST(sum(CASE WHEN value < 1 THEN 1 ELSE 0 END) AS BIGINT) AS failed FROM events GROUP BY 1, 2")
def spend_by_day_type(t):
    return t.events.groupBy(_DAY().alias("day"), "event_type").agg(F.count("*").alias("calls"), F.sum(_cents()).alias("cents"), F.count_if(F.col("value") < 1).alias("failed"))


@query(f"""SELECT event_type, CASE WHEN count(*) >= 5 THEN CAST(sum(cents) AS DOUBLE) / count(*) END AS mean_cents FROM (
  SELECT event_type, {_CENTS_SQL} AS cents, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 50 GROUP BY 1""")
def avg_latest_50(t):
    w = Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    last = t.events.select("event_type", _cents().alias("cents"), F.row_number().over(w).alias("rn")).where("rn <= 50")
    return last.groupBy("event_type").agg(F.when(F.count("*") >= 5, F.sum("cents").cast("double") / F.count("*")).alias("mean_cents"))


@query(f"""SELECT event_type, cents AS p90_cents FROM (SELECT event_type, {_CENTS_SQL} AS cents, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE rn = greatest(1, CAST(ceil(n * 0.9) AS BIGINT))""")
def cost_p90_nearest_rank(t):
    return t.events.groupBy("event_type").agg(F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY value)").alias("value")).select("event_type", _cents().alias("p90_cents"))


@query("""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS views, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS clicks,
  CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS purchases, count(*) AS hits FROM events GROUP BY 1""")
def funnel_pivot_conversion(t):
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    return t.events.groupBy(F.date_format("ts", "yyyy-MM-dd HH").alias("hour")).agg(n("view").alias("views"), n("click").alias("clicks"), n("purchase").alias("purchases"), F.count("*").alias("hits"))


@query("""SELECT event_id, CAST(count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS BIGINT) AS last_hour,
  CAST(count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS BIGINT) AS last_day FROM events""")
def sliding_quota_1h_24h(t):
    at = Window.partitionBy("user_id").orderBy(micros("ts"))
    return t.events.select("event_id", F.count("*").over(at.rangeBetween(-3_600_000_000, 0)).alias("last_hour"), F.count("*").over(at.rangeBetween(-86_400_000_000, 0)).alias("last_day"))


@query("""SELECT user_id, visit, count(*) AS hits, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS since FROM (
  SELECT user_id, ts, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS visit FROM (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY 1, 2""")
def sessions_30min(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = micros("ts") - micros(F.lag("ts").over(w))
    rows = t.events.withColumn("fresh", F.when(gap <= 1_800_000_000, 0).otherwise(1)).withColumn("visit", F.sum("fresh").over(w))
    return rows.groupBy("user_id", "visit").agg(F.count("*").alias("hits"), F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("since"))


@query("""SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS monday, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def week_monday(t):
    return t.events.groupBy(F.date_format(F.date_trunc("WEEK", "ts"), "yyyy-MM-dd").alias("monday"), "event_type").agg(F.count("*").alias("n"))


@query("""SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n, count(DISTINCT user_id) AS people FROM events GROUP BY 1""")
def explode_json_props(t):
    k = F.get_json_object("props", "$.k").cast("long")
    return t.events.groupBy(k.alias("k")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("people"))


@query(f"""WITH g AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(DISTINCT user_id) AS people, count(*) AS n, CAST(sum({_CENTS_SQL}) AS BIGINT) AS cents FROM events GROUP BY 1, 2)
  SELECT day, event_type, CASE WHEN people >= 3 THEN people END AS people, CASE WHEN people >= 3 THEN n END AS n, CASE WHEN people >= 3 THEN cents END AS cents FROM g""")
def k_anonymous_metrics(t):
    g = t.events.groupBy(_DAY().alias("day"), "event_type").agg(F.count_distinct("user_id").alias("people"), F.count("*").alias("n"), F.sum(_cents()).alias("cents"))
    return suppress_small(g, "people", ["n", "cents"]).withColumn("people", F.when(F.col("people") >= 3, F.col("people")))


@query("""WITH g AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_nationkey, c_mktsegment), (c_nationkey))),
  least_n AS (SELECT c_nationkey, min(n) AS low FROM g WHERE c_mktsegment IS NOT NULL GROUP BY 1)
  SELECT c_nationkey, coalesce(c_mktsegment, 'total') AS cohort, CASE WHEN c_mktsegment IS NULL THEN CASE WHEN low >= 3 THEN n END WHEN n >= 3 THEN n END AS n FROM g JOIN least_n USING (c_nationkey)""")
def k_anon_with_total(t):
    """The total is hidden where a group is: it would give the group away."""
    g = t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    total = g.groupBy("c_nationkey").agg(F.when(F.min("n") >= 3, F.sum("n")).alias("n")).withColumn("cohort", F.lit("total"))
    return g.select("c_nationkey", F.col("c_mktsegment").alias("cohort"), F.when(F.col("n") >= 3, F.col("n")).alias("n")).unionByName(total.select("c_nationkey", "cohort", "n"))


@query("""SELECT c_nationkey, CASE WHEN n < 5 THEN '<5' WHEN n < 10 THEN '5-9' WHEN n < 20 THEN '10-19' ELSE '20+' END AS bucket, CASE WHEN n < 20 THEN CAST(floor(n / 5.0 + 0.5) * 5 AS BIGINT) ELSE n END AS rounded,
  least(95, greatest(5, CAST(floor(100.0 * rich / n + 0.5) AS BIGINT))) AS percent FROM (SELECT c_nationkey, count(*) AS n, sum(CASE WHEN c_acctbal > 5000 THEN 1 ELSE 0 END) AS rich FROM customer GROUP BY 1)""")
def masked_cohorts(t):
    g = t.customer.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") > 5000).alias("rich"))
    n = F.col("n")
    return g.select(
        "c_nationkey",
        F.when(n < 5, "<5").when(n < 10, "5-9").when(n < 20, "10-19").otherwise("20+").alias("bucket"),
        F.when(n < 20, F.floor(n / 5 + 0.5) * 5).otherwise(n).cast("long").alias("rounded"),
        F.least(F.lit(95), F.greatest(F.lit(5), F.floor(F.col("rich") * 100.0 / n + 0.5))).cast("long").alias("percent"),
    )


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1), w AS (SELECT day, n, (SELECT coalesce(sum(p.n), 0) FROM d p WHERE p.day BETWEEN d.day - 7 AND d.day - 1) AS week FROM d)
  SELECT strftime(day, '%Y-%m-%d') AS day, n, CAST(week AS BIGINT) AS previous_week, n >= 30 AND 7 * n > 3 * week AS unusual FROM w""")
def volume_anomaly(t):
    d = t.events.groupBy(F.to_date("ts").alias("d")).agg(F.count("*").alias("n"))
    # one row for each day
    week = F.coalesce(F.sum("n").over(Window.orderBy(F.unix_date("d")).rangeBetween(-7, -1)), F.lit(0))
    return d.select(F.date_format("d", "yyyy-MM-dd").alias("day"), "n", week.alias("previous_week"), ((F.col("n") >= 30) & (7 * F.col("n") > 3 * week)).alias("unusual"))


@query("""WITH b AS (SELECT min(CAST(ts AS DATE)) AS a, max(CAST(ts AS DATE)) AS z FROM events), days AS (SELECT CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS day FROM b)
  SELECT strftime(days.day, '%Y-%m-%d') AS day, count(event_id) AS n, count(DISTINCT user_id) AS people FROM days LEFT JOIN events ON CAST(ts AS DATE) = days.day AND event_type = 'purchase' GROUP BY 1""")
def daily_counts_zero_filled(t):
    bounds = t.events.agg(F.to_date(F.min("ts")).alias("a"), F.to_date(F.max("ts")).alias("z"))
    days = bounds.select(F.explode(F.sequence("a", "z")).alias("d"))
    n = t.events.where("event_type = 'purchase'").groupBy(F.to_date("ts").alias("d")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("people"))
    return days.join(n, "d", "left").select(F.date_format("d", "yyyy-MM-dd").alias("day"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("people", F.lit(0)).alias("people"))


@query("""SELECT role, count(*) AS conversations, CAST(sum(n) AS BIGINT) AS turns, max(n) AS longest, CAST(sum(CASE WHEN chars > 1000 THEN 1 ELSE 0 END) AS BIGINT) AS wordy FROM (
  SELECT conv_id, role, count(*) AS n, sum(length(text)) AS chars FROM conversations GROUP BY 1, 2) GROUP BY 1""")
def conversation_metrics(t):
    one = t.conversations.groupBy("conv_id", "role").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    return one.groupBy("role").agg(F.count("*").alias("conversations"), F.sum("n").alias("turns"), F.max("n").alias("longest"), F.count_if(F.col("chars") > 1000).alias("wordy"))


@query("""WITH e AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1), o AS (SELECT o_custkey AS user_id, count(*) AS orders FROM orders GROUP BY 1), k AS (SELECT user_id FROM e UNION SELECT user_id FROM o)
  SELECT k.user_id, coalesce(n, 0) AS purchases, coalesce(orders, 0) AS orders, coalesce(n, 0) >= 3 AND coalesce(orders, 0) >= 10 AS mature FROM k LEFT JOIN e USING (user_id) LEFT JOIN o USING (user_id)""")
def maturity_thresholds(t):
    e = t.events.where("event_type = 'purchase'").groupBy("user_id").agg(F.count("*").alias("n"))
    o = t.orders.groupBy(F.col("o_custkey").alias("user_id")).agg(F.count("*").alias("orders"))
    rows = e.select("user_id").union(o.select("user_id")).distinct().join(e, "user_id", "left").join(o, "user_id", "left")
    n, orders = F.coalesce("n", F.lit(0)), F.coalesce("orders", F.lit(0))
    return rows.select("user_id", n.alias("purchases"), orders.alias("orders"), ((n >= 3) & (orders >= 10)).alias("mature"))


@query("""SELECT user_id, last_five_errors, streak FROM (SELECT user_id, CAST(sum(CASE WHEN bad THEN 1 ELSE 0 END) AS BIGINT) AS last_five_errors, CAST(sum(CASE WHEN good_before = 0 AND bad THEN 1 ELSE 0 END) AS BIGINT) AS streak FROM (
  SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY rn) AS good_before FROM (
  SELECT user_id, event_type <> 'purchase' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 5) GROUP BY 1)""")
def runs_last5_and_error_streak(t):
    """The last five runs of each source, and how many of the latest failed in a row."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    five = t.events.select("user_id", (F.col("event_type") != "purchase").alias("bad"), F.row_number().over(w).alias("rn")).where("rn <= 5")
    good = F.sum(F.when(F.col("bad"), 0).otherwise(1)).over(Window.partitionBy("user_id").orderBy("rn"))
    rows = five.withColumn("good_before", good)
    return rows.groupBy("user_id").agg(F.count_if("bad").alias("last_five_errors"), F.count_if((F.col("good_before") == 0) & F.col("bad")).alias("streak"))


@query("""SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS applied, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') AS interview FROM customer""")
def semi_exists_flags(t):
    of = lambda where: t.orders.where(where).select(F.col("o_custkey").alias("c_custkey"))
    return with_exists(with_exists(t.customer.select("c_custkey"), of("o_orderstatus = 'F'"), "c_custkey", "applied"), of("o_orderpriority = '1-URGENT'"), "c_custkey", "interview")


@query(f"""SELECT user_id, CAST(total AS BIGINT) AS total, [x FOR x IN [70, 85, 95] IF total * 100 >= x * 200000] AS crossed FROM (SELECT user_id, sum({_CENTS_SQL}) AS total FROM events GROUP BY 1)""")
def budget_crossing(t):
    """Shares of a budget of 200,000 cents that spending has reached."""
    total = t.events.groupBy("user_id").agg(F.sum(_cents()).alias("total"))
    marks = F.array(*[F.lit(x) for x in (70, 85, 95)])
    return total.select("user_id", "total", F.filter(marks, lambda x: F.col("total") * 100 >= x * 200_000).alias("crossed"))


@query(f"""SELECT event_id, CAST(spent AS BIGINT) AS spent, spent <= 50000 AS allowed FROM (SELECT event_id, sum({_CENTS_SQL}) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS spent FROM events)""")
def daily_cap_running_spend(t):
    w = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t.events.select("event_id", F.sum(_cents()).over(w).alias("spent")).withColumn("allowed", F.col("spent") <= 50_000)


@query("""SELECT CASE WHEN attempts > 4 THEN least(15, CAST(pow(2, least(attempts, 9) - 5) AS BIGINT)) ELSE 0 END AS lock_minutes, count(*) AS people FROM (
  SELECT user_id, count(*) AS attempts FROM events WHERE event_type = 'click' GROUP BY 1) GROUP BY 1""")
def lockout_minutes(t):
    """From the fifth attempt on the lock doubles, to 15 minutes at most."""
    n = t.events.where("event_type = 'click'").groupBy("user_id").agg(F.count("*").alias("attempts"))
    lock = F.when(F.col("attempts") > 4, F.least(F.lit(15), F.pow(F.lit(2), F.least("attempts", F.lit(9)) - 5).cast("long"))).otherwise(0).cast("long")
    return n.groupBy(lock.alias("lock_minutes")).agg(F.count("*").alias("people"))


@query("""WITH old AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0), new AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 3 <> 1)
  SELECT coalesce(n.o_orderkey, o.o_orderkey) AS o_orderkey, coalesce(n.o_orderstatus, o.o_orderstatus) AS o_orderstatus,
  CASE WHEN n.o_orderkey IS NULL THEN 'kept' WHEN o.o_orderkey IS NULL THEN 'inserted' WHEN n.o_orderstatus = o.o_orderstatus AND n.o_totalprice = o.o_totalprice THEN 'unchanged' ELSE 'updated' END AS change FROM old o FULL JOIN new n ON o.o_orderkey = n.o_orderkey""")
def upsert_merge_state(t):
    rows = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = rows.where("o_orderkey % 3 <> 1").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus")))
    return merge_rows(rows.where("o_orderkey % 3 <> 0"), new, ["o_orderkey"], ["o_orderstatus", "o_totalprice"]).select("o_orderkey", "o_orderstatus", "change")


@query("""SELECT l_orderkey, l_linenumber FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderdate >= TIMESTAMP '1996-01-01') AND NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 10)""")
def retention_orphans(t):
    """Rows that neither a recent order nor a large part holds: two anti joins."""
    recent = t.orders.where(F.col("o_orderdate") >= "1996-01-01").select(F.col("o_orderkey").alias("l_orderkey"))
    large = t.part.where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey").join(large, "l_partkey", "left_anti").join(recent, "l_orderkey", "left_anti").select("l_orderkey", "l_linenumber")


@query("""SELECT o_orderstatus AS status, count(*) AS n, CAST(sum(CASE WHEN o_orderdate <= TIMESTAMP '1997-01-01' THEN 1 ELSE 0 END) AS BIGINT) AS eligible, CAST(max(date_diff('minute', o_orderdate, TIMESTAMP '1999-01-01')) AS BIGINT) AS oldest_minutes FROM orders GROUP BY 1""")
def queue_stats(t):
    now = F.lit("1999-01-01").cast("timestamp")
    minutes = F.floor((micros(now) - micros("o_orderdate")) / 60_000_000).cast("long")
    return t.orders.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderdate") <= "1997-01-01").alias("eligible"), F.max(minutes).alias("oldest_minutes"))


@query("""SELECT o_orderkey, attempts, CASE WHEN attempts > 0 THEN least(3600, CAST(60 * pow(2, attempts - 1) AS BIGINT)) ELSE 0 END AS wait_seconds FROM (SELECT o_orderkey, count(*) FILTER (l_returnflag = 'R') AS attempts FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)""")
def queue_backoff(t):
    tries = t.lineitem.groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("attempts"))
    rows = tries.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    wait = F.when(F.col("attempts") > 0, F.least(F.lit(3600), (60 * F.pow(F.lit(2), F.col("attempts") - 1)).cast("long"))).otherwise(0).cast("long")
    return rows.select(F.col("l_orderkey").alias("o_orderkey"), "attempts", wait.alias("wait_seconds"))


@query("""WITH s AS (SELECT quality, toxic, CASE WHEN n_chars >= 4000 THEN 8 WHEN n_chars >= 1000 THEN 6 ELSE 3 END AS score FROM labels JOIN documents USING (doc_id))
  SELECT CASE WHEN score >= 7 THEN 'high' WHEN score >= 5 THEN 'middle' ELSE 'low' END AS band, count(*) AS n, CAST(sum(quality) AS BIGINT) AS positive, round(avg(quality * 1.0::DOUBLE), 4) AS positive_rate, round(avg(abs(score - 10 * quality) * 1.0::DOUBLE), 4) AS mae, round(avg((score - 10 * quality) * 1.0::DOUBLE), 4) AS bias FROM s GROUP BY 1""")
def feedback_bands_mae_bias(t):
    rows = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id")
    rows = rows.withColumn("score", F.when(F.col("n_chars") >= 4000, 8).when(F.col("n_chars") >= 1000, 6).otherwise(3))
    off = F.col("score") - 10 * F.col("quality")
    band = F.when(F.col("score") >= 7, "high").when(F.col("score") >= 5, "middle").otherwise("low")
    return rows.groupBy(band.alias("band")).agg(
        F.count("*").alias("n"), F.sum("quality").alias("positive"), F.round(F.avg("quality"), 4).alias("positive_rate"), F.round(F.avg(F.abs(off)), 4).alias("mae"), F.round(F.avg(off), 4).alias("bias")
    )


@query("""WITH g AS (SELECT o_orderpriority AS source, count(*) AS total, CAST(sum(CASE WHEN o_totalprice >= 150000 THEN 1 ELSE 0 END) AS BIGINT) AS good, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS applied FROM orders GROUP BY 1)
  SELECT *, total < 3100 AS few FROM g""")
def portal_stats(t):
    g = t.orders.groupBy(F.col("o_orderpriority").alias("source")).agg(F.count("*").alias("total"), F.count_if(F.col("o_totalprice") >= 150000).alias("good"), F.count_if(F.col("o_orderstatus") == "F").alias("applied"))
    return g.withColumn("few", F.col("total") < 3100)


@query("""WITH x AS (SELECT toxic = 1 AS truth, n_chars > 3000 AS guess FROM labels JOIN documents USING (doc_id)) SELECT count(*) AS n, CAST(sum(CASE WHEN truth AND guess THEN 1 ELSE 0 END) AS BIGINT) AS hits,
  round(sum(CASE WHEN truth AND guess THEN 1 ELSE 0 END)::DOUBLE / sum(CASE WHEN truth THEN 1 ELSE 0 END), 4) AS recall, round(sum(CASE WHEN truth AND guess THEN 1 ELSE 0 END)::DOUBLE / sum(CASE WHEN guess THEN 1 ELSE 0 END), 4) AS precision,
  round(sum(CASE WHEN truth = guess THEN 1 ELSE 0 END)::DOUBLE / count(*), 4) AS accuracy FROM x""")
def eval_metrics(t):
    x = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").select((F.col("toxic") == 1).alias("truth"), (F.col("n_chars") > 3000).alias("guess"))
    both, n = F.count_if(F.col("truth") & F.col("guess")), F.count("*")
    return x.agg(n.alias("n"), both.alias("hits"), F.round(both / F.count_if("truth"), 4).alias("recall"), F.round(both / F.count_if("guess"), 4).alias("precision"), F.round(F.count_if(F.col("truth") == F.col("guess")) / n, 4).alias("accuracy"))
