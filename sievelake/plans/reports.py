"""Further reports: fit summaries, hint transitions, skill candidates, health boards, digests, expiry notices, run comparisons."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sievelake.operators.core import micros, top_n_per_group
from sievelake.plans.registry import query


@query("""WITH i AS (SELECT o_custkey, p_brand AS item, CASE l_returnflag WHEN 'R' THEN 'blocker' WHEN 'A' THEN 'unknown' ELSE 'met' END AS state FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE o_orderpriority = '1-URGENT'),
  n AS (SELECT count(DISTINCT o_custkey) AS people FROM i), g AS (SELECT state, item, count(DISTINCT o_custkey) AS n FROM i WHERE state <> 'met' GROUP BY 1, 2)
  SELECT state, item, n, position FROM (SELECT state, item, n, row_number() OVER (PARTITION BY state ORDER BY n DESC, item) AS position FROM g, n WHERE n >= 2 AND 100 * n >= 20 * people) WHERE position <= 3""")
def fit_summary_groups(t):
    """Blocking and unknown items that at least two people and a fifth of all share; the first three of each kind."""
    rows = t.orders.where("o_orderpriority = '1-URGENT'").join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    state = F.when(F.col("l_returnflag") == "R", "blocker").when(F.col("l_returnflag") == "A", "unknown").otherwise("met")
    items = rows.select("o_custkey", F.col("p_brand").alias("item"), state.alias("state"))
    people = items.agg(F.count_distinct("o_custkey").alias("people"))
    g = items.where("state <> 'met'").groupBy("state", "item").agg(F.count_distinct("o_custkey").alias("n"))
    # one row of totals
    g = g.join(F.broadcast(people), (F.col("n") >= 2) & (100 * F.col("n") >= 20 * F.col("people")))
    return top_n_per_group(g.select("state", "item", "n"), ["state"], 3, F.desc("n"), F.asc("item"))


@query("""WITH s AS (SELECT source, lang AS stored, CASE WHEN n_chars > 5000 THEN 'long' ELSE lang END AS computed FROM documents)
  SELECT coalesce(stored, computed) AS role, coalesce(was, 0) AS stored_count, coalesce(now_n, 0) AS computed_count FROM (SELECT stored, count(*) AS was FROM s GROUP BY 1) FULL JOIN (SELECT computed, count(*) AS now_n FROM s GROUP BY 1) ON stored = computed""")
def hints_report(t):
    """Stored against recomputed roles."""
    s = t.documents.select(F.col("lang").alias("stored"), F.when(F.col("n_chars") > 5000, "long").otherwise(F.col("lang")).alias("computed"))
    was = s.groupBy(F.col("stored").alias("role")).agg(F.count("*").alias("was"))
    now = s.groupBy(F.col("computed").alias("role")).agg(F.count("*").alias("now_n"))
    return was.join(now, "role", "full").select("role", F.coalesce("was", F.lit(0)).alias("stored_count"), F.coalesce("now_n", F.lit(0)).alias("computed_count"))


@query("""SELECT lang AS stored, CASE WHEN n_chars > 5000 THEN 'long' ELSE lang END AS computed, count(*) AS n FROM documents GROUP BY 1, 2""")
def hints_transitions(t):
    computed = F.when(F.col("n_chars") > 5000, "long").otherwise(F.col("lang"))
    return t.documents.groupBy(F.col("lang").alias("stored"), computed.alias("computed")).agg(F.count("*").alias("n"))


@query("""WITH w AS (SELECT p_partkey, unnest(list_filter(string_split_regex(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')) AS term FROM part), known AS (SELECT lower(s_name) AS name FROM supplier)
  SELECT term, count(DISTINCT p_partkey) AS postings FROM w WHERE NOT EXISTS (SELECT 1 FROM known WHERE name = term) GROUP BY 1 HAVING count(DISTINCT p_partkey) >= 2 ORDER BY postings DESC, term LIMIT 50""")
def skill_candidates(t):
    """Terms in at least two postings that are no known name."""
    words = F.filter(F.split(F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", " "), " "), lambda x: x != "")
    terms = t.part.select("p_partkey", F.explode(words).alias("term")).join(t.supplier.select(F.lower("s_name").alias("term")), "term", "left_anti")
    return terms.groupBy("term").agg(F.count_distinct("p_partkey").alias("postings")).where("postings >= 2").orderBy(F.desc("postings"), "term").limit(50)


@query("""WITH d AS (SELECT event_type AS area, CAST(date_diff('minute', max(ts), (SELECT max(ts) FROM events)) AS BIGINT) AS idle, CAST(sum(CASE WHEN value < 1 THEN 1 ELSE 0 END) AS BIGINT) AS failed, count(*) AS n FROM events GROUP BY 1)
  SELECT area, idle, failed, n, CASE WHEN idle > 1440 OR 10 * failed > n THEN 2 WHEN idle > 60 OR 50 * failed > n THEN 1 ELSE 0 END AS level, max(CASE WHEN idle > 1440 OR 10 * failed > n THEN 2 WHEN idle > 60 OR 50 * failed > n THEN 1 ELSE 0 END) OVER () AS overall FROM d""")
def health_board(t):
    """A level for each area; the worst is that of the whole board."""
    d = t.events.groupBy(F.col("event_type").alias("area")).agg(F.max("ts").alias("last"), F.count_if(F.col("value") < 1).alias("failed"), F.count("*").alias("n"))
    # minute boundaries passed since; the window is over one row for each area
    minute = F.floor(micros("last") / 60_000_000).cast("long")
    d = d.withColumn("idle", F.max(minute).over(Window.partitionBy(F.lit(0))) - minute)
    level = F.when((F.col("idle") > 1440) | (10 * F.col("failed") > F.col("n")), 2).when((F.col("idle") > 60) | (50 * F.col("failed") > F.col("n")), 1).otherwise(0)
    return d.select("area", "idle", "failed", "n", level.alias("level")).withColumn("overall", F.max("level").over(Window.partitionBy(F.lit(0))))


@query("""WITH n AS (SELECT lang, source, count(*) AS offers FROM documents WHERE n_chars > 2000 GROUP BY 1, 2) SELECT lang, source, offers FROM n WHERE offers < 5""")
def few_offers(t):
    return t.documents.where("n_chars > 2000").groupBy("lang", "source").agg(F.count("*").alias("offers")).where("offers < 5")


@query("""SELECT user_id, strftime(ts, '%G-W%V') AS period, count(*) AS n, count(DISTINCT event_type) AS kinds, round(max(value), 4) AS best FROM events GROUP BY 1, 2""")
def weekly_digest(t):
    """One digest for each person and ISO week."""
    thursday = F.date_add(F.date_trunc("WEEK", "ts").cast("date"), 3)
    period = F.concat(F.year(thursday).cast("string"), F.lit("-W"), F.lpad(F.weekofyear("ts").cast("string"), 2, "0"))
    return t.events.groupBy("user_id", period.alias("period")).agg(F.count("*").alias("n"), F.count_distinct("event_type").alias("kinds"), F.round(F.max("value"), 4).alias("best"))


@query("""WITH last AS (SELECT o_custkey, max(o_orderdate) AS d FROM orders GROUP BY 1), told AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase')
  SELECT o_custkey, strftime(d, '%Y-%m-%d') AS until FROM last WHERE d >= TIMESTAMP '1998-06-01' AND d < TIMESTAMP '1998-08-01' AND NOT EXISTS (SELECT 1 FROM told WHERE user_id = o_custkey)""")
def plan_expiry_notices(t):
    last = t.orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("d")).where((F.col("d") >= "1998-06-01") & (F.col("d") < "1998-08-01"))
    told = t.events.where("event_type = 'purchase'").select(F.col("user_id").alias("o_custkey"))
    return last.join(told, "o_custkey", "left_anti").select("o_custkey", F.date_format("d", "yyyy-MM-dd").alias("until"))


@query("""WITH r AS (SELECT CAST(o_orderkey % 3 AS INT) AS run, o_orderpriority AS split, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS cents FROM orders), m AS (SELECT split, run, CAST(sum(cents) AS DOUBLE) / count(*) AS mean FROM r GROUP BY 1, 2)
  SELECT split, count(*) AS runs, round(avg(mean), 2) AS mean, round(max(mean) - min(mean), 2) AS spread FROM m GROUP BY 1""")
def run_dispersion(t):
    """Mean of each run, then mean and range over runs."""
    r = t.orders.groupBy(F.col("o_orderpriority").alias("split"), (F.col("o_orderkey") % 3).alias("run"))
    m = r.agg((F.sum(F.floor(F.col("o_totalprice") * 100 + 0.5).cast("long")).cast("double") / F.count("*")).alias("mean"))
    return m.groupBy("split").agg(F.count("*").alias("runs"), F.round(F.avg("mean"), 2).alias("mean"), F.round(F.max("mean") - F.min("mean"), 2).alias("spread"))


@query("""WITH x AS (SELECT p_partkey, p_retailprice AS amount, CASE p_size % 4 WHEN 0 THEN 'mensual' WHEN 1 THEN 'anual' WHEN 2 THEN 'hora' END AS period FROM part),
  m AS (SELECT p_partkey, CASE period WHEN 'mensual' THEN floor(amount + 0.5) WHEN 'anual' THEN floor(amount / 12 + 0.5) WHEN 'hora' THEN floor(amount * 160 + 0.5) END AS monthly FROM x)
  SELECT p_partkey, CAST(monthly AS BIGINT) AS monthly, coalesce(monthly BETWEEN 200 AND 40000, false) AS plausible FROM m""")
def monthly_salaries(t):
    from sievelake.functions.text import monthly_usd

    kind = F.col("p_size") % 4
    period = F.when(kind == 0, "mensual").when(kind == 1, "anual").when(kind == 2, "hora")
    m = t.part.select("p_partkey", monthly_usd(F.col("p_retailprice"), period).alias("monthly"))
    return m.withColumn("plausible", F.coalesce(F.col("monthly").between(200, 40000), F.lit(False)))


@query("""SELECT c_custkey, strftime(greatest(o_last, e_last), '%Y-%m-%d') AS last_day FROM customer LEFT JOIN (SELECT o_custkey AS c_custkey, max(CAST(o_orderdate AS DATE)) AS o_last FROM orders GROUP BY 1) USING (c_custkey)
  LEFT JOIN (SELECT user_id AS c_custkey, max(CAST(ts AS DATE)) AS e_last FROM events GROUP BY 1) USING (c_custkey) WHERE greatest(o_last, e_last) <= DATE '1998-12-31' - 30""")
def inactive_people(t):
    """No activity of any kind for 30 days; ``greatest`` passes over nulls."""
    o = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.to_date(F.max("o_orderdate")).alias("o_last"))
    e = t.events.groupBy(F.col("user_id").alias("c_custkey")).agg(F.to_date(F.max("ts")).alias("e_last"))
    rows = t.customer.select("c_custkey").join(o, "c_custkey", "left").join(e, "c_custkey", "left").withColumn("last", F.greatest("o_last", "e_last"))
    return rows.where(F.datediff(F.lit("1998-12-31").cast("date"), "last") >= 30).select("c_custkey", F.date_format("last", "yyyy-MM-dd").alias("last_day"))


@query("""SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS bucket, event_type, count(*) AS n, CAST(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS BIGINT) AS high FROM events GROUP BY CUBE (1, 2)""")
def cube_counts(t):
    bucket = F.get_json_object("props", "$.k").cast("long") % 5
    return t.events.select(bucket.alias("bucket"), "event_type", "value").cube("bucket", "event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("high"))
