"""Market reports: demand, coverage, salaries, showcase. A customer stands for a posting with a history of scores (its orders), a
part's brand for a skill, a line item for a mention (returned: required)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sievelake.operators.core import latest_per_key, micros, pre_score, plan_priority, top_n_per_group, weighted_demand
from sievelake.plans.registry import query

_LATEST_SQL = """latest AS (SELECT o_custkey, CAST(floor(least(o_totalprice / 50000, 10) * 10 + 0.5) AS BIGINT) AS score10 FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1)"""
_MENTIONS_SQL = """mentions AS (SELECT o_custkey, p_brand AS skill, bool_or(l_returnflag = 'R') AS must
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""
_DEMAND_SQL = f"""{_LATEST_SQL}, {_MENTIONS_SQL}, demand AS (SELECT skill, count(*) AS mentions, CAST(sum(CASE WHEN must THEN 1 ELSE 0 END) AS BIGINT) AS must_mentions,
  round(CAST(sum(coalesce(score10, 50) * CASE WHEN must THEN 10 ELSE 4 END) AS DOUBLE) / 100, 2) AS weighted_demand
  FROM mentions LEFT JOIN latest USING (o_custkey) GROUP BY skill)"""


def latest_scores(t):
    last = latest_per_key(t.orders.select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice"), ["o_custkey"], -micros("o_orderdate"), -F.col("o_orderkey"))
    return last.select("o_custkey", F.floor(F.least(F.col("o_totalprice") / 50000, F.lit(10.0)) * 10 + 0.5).cast("long").alias("score10"))


def mentions(t):
    lines = t.lineitem.select("l_orderkey", "l_partkey", "l_returnflag")
    named = lines.join(t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("skill")), "l_partkey")
    owned = named.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    return owned.groupBy("o_custkey", "skill").agg(F.bool_or(F.col("l_returnflag") == "R").alias("must"))


def demand(t):
    return weighted_demand(mentions(t).join(latest_scores(t), "o_custkey", "left"), "skill", "score10", "must")


@query(f"WITH {_DEMAND_SQL} SELECT * FROM demand")
def demand_snapshot(t):
    return demand(t)


@query(f"WITH {_LATEST_SQL} SELECT * FROM latest")
def latest_score_per_key(t):
    return latest_scores(t)


@query("""SELECT o_custkey, o_orderkey AS first_order, strftime(o_orderdate, '%Y-%m-%d') AS first_day FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def earliest_per_key(t):
    first = latest_per_key(t.orders.select("o_custkey", "o_orderdate", "o_orderkey"), ["o_custkey"], F.col("o_orderdate"), F.col("o_orderkey"))
    return first.select("o_custkey", F.col("o_orderkey").alias("first_order"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("first_day"))


@query("""SELECT skill, count(*) AS mentions, CAST(sum(CASE WHEN must THEN 1 ELSE 0 END) AS BIGINT) AS must_mentions FROM (
  SELECT l_orderkey, p_brand AS skill, bool_or(l_returnflag = 'R') AS must FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) GROUP BY skill""")
def role_demand_dedup_must(t):
    one = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey", F.col("p_brand").alias("skill")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("must"))
    return one.groupBy("skill").agg(F.count("*").alias("mentions"), F.count_if("must").alias("must_mentions"))


@query("""SELECT strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS week_start, o_orderpriority AS role, count(*) AS jobs, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS done
  FROM orders GROUP BY 1, 2""")
def role_week_snapshots(t):
    week = F.date_format(F.date_trunc("WEEK", "o_orderdate"), "yyyy-MM-dd")
    return t.orders.groupBy(week.alias("week_start"), F.col("o_orderpriority").alias("role")).agg(F.count("*").alias("jobs"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))


@query("""WITH weeks AS (SELECT o_orderpriority AS role, date_trunc('week', o_orderdate) AS week, p_brand AS skill, count(*) AS mentions, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS must_mentions
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3),
  last AS (SELECT role, max(week) AS week FROM weeks GROUP BY 1)
  SELECT role, strftime(week, '%Y-%m-%d') AS week_start, skill, mentions, must_mentions, position FROM (
  SELECT w.*, row_number() OVER (PARTITION BY role ORDER BY mentions DESC, must_mentions DESC, skill) AS position FROM weeks w JOIN last USING (role, week)) WHERE position <= 5""")
def role_market_top(t):
    rows = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    weeks = rows.groupBy(F.col("o_orderpriority").alias("role"), F.date_trunc("WEEK", "o_orderdate").alias("week"), F.col("p_brand").alias("skill")).agg(
        F.count("*").alias("mentions"), F.count_if(F.col("l_returnflag") == "R").alias("must_mentions")
    )
    last = weeks.groupBy("role").agg(F.max("week").alias("week"))
    top = top_n_per_group(weeks.join(last, ["role", "week"]), ["role"], 5, F.desc("mentions"), F.desc("must_mentions"), F.col("skill"))
    return top.select("role", F.date_format("week", "yyyy-MM-dd").alias("week_start"), "skill", "mentions", "must_mentions", "position")


@query(f"""WITH {_DEMAND_SQL}, levels AS (SELECT p_brand AS skill, CAST(min(p_size) % 4 AS INT) AS level FROM part GROUP BY 1)
  SELECT d.skill, mentions, weighted_demand, level, CASE WHEN mentions >= 2 AND coalesce(level, 0) <= 1 THEN 'gap' WHEN level = 3 THEN 'differential' WHEN level = 2 THEN 'growing' END AS agenda FROM demand d LEFT JOIN levels USING (skill)""")
def agenda_gaps(t):
    levels = t.part.groupBy(F.col("p_brand").alias("skill")).agg((F.min("p_size") % 4).cast("int").alias("level"))
    agenda = F.when((F.col("mentions") >= 2) & (F.coalesce("level", F.lit(0)) <= 1), "gap").when(F.col("level") == 3, "differential").when(F.col("level") == 2, "growing")
    return demand(t).join(levels, "skill", "left").select("skill", "mentions", "weighted_demand", "level", agenda.alias("agenda"))


@query("""SELECT c_mktsegment AS segment, n_regionkey AS region, count(*) AS total, CAST(sum(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END) AS BIGINT) AS informed,
  CASE WHEN sum(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END) >= 10 THEN round(quantile_cont(CASE WHEN c_acctbal > 0 THEN c_acctbal END, 0.25), 4) END AS p25,
  CASE WHEN sum(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END) >= 10 THEN round(quantile_cont(CASE WHEN c_acctbal > 0 THEN c_acctbal END, 0.5), 4) END AS median,
  CASE WHEN sum(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END) >= 10 THEN round(quantile_cont(CASE WHEN c_acctbal > 0 THEN c_acctbal END, 0.75), 4) END AS p75
  FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""")
def salary_percentiles_by_segment(t):
    amount = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))
    rows = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("c_mktsegment").alias("segment"), F.col("n_regionkey").alias("region"))
    got = rows.agg(F.count("*").alias("total"), F.count(amount).alias("informed"), F.percentile(amount, [0.25, 0.5, 0.75]).alias("p"))
    enough = F.col("informed") >= 10
    return got.select("segment", "region", "total", "informed", *[F.when(enough, F.round(F.col("p")[k], 4)).alias(c) for k, c in enumerate(("p25", "median", "p75"))])


@query("""WITH r AS (SELECT source, lang, count(*) AS active, CAST(sum(CASE WHEN n_chars >= 1000 THEN 1 ELSE 0 END) AS BIGINT) AS long_active, CAST(sum(CASE WHEN lang = 'es' THEN 1 ELSE 0 END) AS BIGINT) AS spanish FROM documents GROUP BY 1, 2)
  SELECT *, active < 5 AS low FROM r""")
def coverage_filter_counts(t):
    got = t.documents.groupBy("source", "lang").agg(F.count("*").alias("active"), F.count_if(F.col("n_chars") >= 1000).alias("long_active"), F.count_if(F.col("lang") == "es").alias("spanish"))
    return got.withColumn("low", F.col("active") < 5)


@query("""WITH spelled AS (SELECT lower(p_name) AS folded, p_name, count(*) AS n FROM part GROUP BY 1, 2),
  best AS (SELECT folded, p_name, row_number() OVER (PARTITION BY folded ORDER BY n DESC, p_name) AS rn, CAST(sum(n) OVER (PARTITION BY folded) AS BIGINT) AS jobs FROM spelled)
  SELECT p_name AS company, jobs FROM best WHERE rn = 1 ORDER BY jobs DESC, company LIMIT 10""")
def showcase_top_companies_dominant_spelling(t):
    spelled = t.part.groupBy(F.lower("p_name").alias("folded"), "p_name").agg(F.count("*").alias("n"))
    best = spelled.groupBy("folded").agg(F.min_by("p_name", F.struct(-F.col("n"), "p_name")).alias("company"), F.sum("n").alias("jobs"))
    return best.select("company", "jobs").orderBy(F.desc("jobs"), "company").limit(10)


@query("""SELECT count(*) AS total, count(DISTINCT source) AS sources, CAST(sum(CASE WHEN lang = 'en' THEN 1 ELSE 0 END) AS BIGINT) AS english, CAST(sum(CASE WHEN lang = 'es' THEN 1 ELSE 0 END) AS BIGINT) AS spanish,
  CAST(sum(CASE WHEN lang NOT IN ('en', 'es') THEN 1 ELSE 0 END) AS BIGINT) AS other, max(n_chars) AS longest FROM documents""")
def career_market_totals(t):
    return t.documents.agg(
        F.count("*").alias("total"), F.count_distinct("source").alias("sources"), F.count_if(F.col("lang") == "en").alias("english"), F.count_if(F.col("lang") == "es").alias("spanish"),
        F.count_if(~F.col("lang").isin("en", "es")).alias("other"), F.max("n_chars").alias("longest"),
    )


_COVERED_SQL = f"""{_LATEST_SQL}, {_MENTIONS_SQL}, levels AS (SELECT p_brand AS skill, CAST(min(p_size) % 4 AS INT) AS level FROM part GROUP BY 1),
  known AS (SELECT o_custkey, skill, level FROM mentions JOIN levels USING (skill)),
  balance AS (SELECT c_custkey AS o_custkey, CASE WHEN c_acctbal < 1000 THEN 1.0 ELSE 0.0 END AS penalty, CASE WHEN c_mktsegment = 'BUILDING' THEN 6.0 ELSE 10.0 END AS cap FROM customer)"""


def _covered(t):
    levels = t.part.groupBy(F.col("p_brand").alias("skill")).agg((F.min("p_size") % 4).cast("int").alias("level"))
    known = mentions(t).join(F.broadcast(levels), "skill").select("o_custkey", "skill", "level")
    cap, penalty = F.when(F.col("c_mktsegment") == "BUILDING", 6.0).otherwise(10.0), F.when(F.col("c_acctbal") < 1000, 1.0).otherwise(0.0)
    return known, t.customer.select(F.col("c_custkey").alias("o_custkey"), penalty.alias("penalty"), cap.alias("cap"))


@query(f"""WITH {_COVERED_SQL}, cover AS (SELECT o_custkey, count(*) AS known_skills, CAST(sum(CASE WHEN level >= 2 THEN 1 ELSE 0 END) AS BIGINT) AS have FROM known GROUP BY 1)
  SELECT o_custkey, coalesce(known_skills, 0) AS known_skills, coalesce(have, 0) AS have, floor(greatest(0.0, least(10.0, least(coalesce(3 + 6 * (CAST(have AS DOUBLE) / known_skills), 5.0) - penalty, cap))) * 2 + 0.5) / 2 AS score
  FROM balance LEFT JOIN cover USING (o_custkey)""")
def prescore(t):
    known, balance = _covered(t)
    cover = known.groupBy("o_custkey").agg(F.count("*").alias("known_skills"), F.count_if(F.col("level") >= 2).alias("have"))
    rows = balance.join(cover, "o_custkey", "left")
    score = pre_score(F.col("have") / F.col("known_skills"), F.col("penalty"), F.col("cap"))
    return rows.select("o_custkey", F.coalesce("known_skills", F.lit(0)).alias("known_skills"), F.coalesce("have", F.lit(0)).alias("have"), score.alias("score"))


@query(f"""WITH {_COVERED_SQL}, cover AS (SELECT o_custkey, count(*) AS n, CAST(sum(CASE WHEN level >= 2 THEN 1 ELSE 0 END) AS BIGINT) AS have FROM known GROUP BY 1),
  asks AS (SELECT k.skill, k.level, c.n, c.have, penalty, cap FROM known k JOIN cover c USING (o_custkey) JOIN balance USING (o_custkey)),
  scored AS (SELECT skill, floor(greatest(0.0, least(10.0, least(3 + 6 * (CAST(have AS DOUBLE) / n) - penalty, cap))) * 2 + 0.5) / 2 AS now_score,
    floor(greatest(0.0, least(10.0, least(3 + 6 * (CAST(have + CASE WHEN level < 2 THEN 1 ELSE 0 END AS DOUBLE) / n) - penalty, cap))) * 2 + 0.5) / 2 AS later_score FROM asks)
  SELECT skill, count(*) AS asks, CAST(sum(CASE WHEN now_score >= 7 THEN 1 ELSE 0 END) AS BIGINT) AS pass_now, CAST(sum(CASE WHEN later_score >= 7 THEN 1 ELSE 0 END) AS BIGINT) AS pass_after FROM scored GROUP BY skill""")
def simulate_skill_delta(t):
    """Only postings that ask for a skill can change with it, so scenarios follow mentions and nothing is crossed."""
    known, balance = _covered(t)
    cover = known.groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("level") >= 2).alias("have"))
    asks = known.join(cover, "o_custkey").join(balance, "o_custkey")
    score = lambda have: pre_score(have / F.col("n"), F.col("penalty"), F.col("cap"))
    later = F.col("have") + F.when(F.col("level") < 2, 1).otherwise(0)
    return asks.groupBy("skill").agg(F.count("*").alias("asks"), F.count_if(score(F.col("have")) >= 7).alias("pass_now"), F.count_if(score(later) >= 7).alias("pass_after"))


@query(f"""WITH {_DEMAND_SQL}, dim AS (SELECT p_brand AS skill, CAST(min(p_size) % 4 AS INT) AS level, CAST(max(p_size) AS DOUBLE) AS hours FROM part GROUP BY 1)
  SELECT skill, weighted_demand, floor(weighted_demand * (1 - level / 3.0::DOUBLE) * (CASE WHEN hours IS NULL THEN 0.5 WHEN hours <= 0 THEN 1.0 ELSE least(1.0, greatest(0.1, 16 / hours)) END)::DOUBLE * 100 + 0.5) / 100 AS priority
  FROM demand JOIN dim USING (skill) WHERE level < 3 AND weighted_demand > 0""")
def plan_priorities(t):
    dim = t.part.groupBy(F.col("p_brand").alias("skill")).agg((F.min("p_size") % 4).cast("int").alias("level"), F.max("p_size").cast("double").alias("hours"))
    rows = demand(t).join(F.broadcast(dim), "skill").where((F.col("level") < 3) & (F.col("weighted_demand") > 0))
    return rows.select("skill", "weighted_demand", plan_priority(F.col("weighted_demand"), F.col("level"), F.col("hours")).alias("priority"))


@query("""SELECT o_orderkey AS card, list(skill ORDER BY must DESC, skill)[1:5] AS skills FROM (
  SELECT l_orderkey AS o_orderkey, p_brand AS skill, bool_or(l_returnflag = 'R') AS must FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) GROUP BY 1""")
def topn_must_first_per_group(t):
    one = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_orderkey").alias("card"), F.col("p_brand").alias("skill")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("must"))
    ordered = F.array_sort(F.collect_list(F.struct(F.when(F.col("must"), 0).otherwise(1).alias("k"), "skill")))
    return one.groupBy("card").agg(F.slice(F.transform(ordered, lambda x: x["skill"]), 1, 5).alias("skills"))


@query("""SELECT card, hit, position FROM (SELECT o_orderkey AS card, o_orderpriority = '1-URGENT' AS hit, row_number() OVER (ORDER BY o_orderpriority = '1-URGENT' DESC, o_orderstatus = 'P', o_totalprice DESC, o_orderdate DESC, o_orderkey) AS position FROM orders) WHERE position <= 300""")
def rank_by_seven_keys(t):
    """Rank on narrow columns and keep the best 300; wide columns would be joined back to these."""
    hit = F.col("o_orderpriority") == "1-URGENT"
    order = [F.desc("hit"), F.asc("outside"), F.desc("o_totalprice"), F.desc("o_orderdate"), F.asc("card")]
    rows = t.orders.select(F.col("o_orderkey").alias("card"), hit.alias("hit"), (F.col("o_orderstatus") == "P").alias("outside"), "o_totalprice", "o_orderdate")
    best = rows.orderBy(*order).limit(300)
    # at most 300 rows reach this window
    return best.withColumn("position", F.row_number().over(Window.orderBy(*order))).select("card", "hit", "position")


@query("""WITH r AS (SELECT o_orderkey, o_orderpriority AS role, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders WHERE o_orderstatus = 'F')
  SELECT o_orderkey, role, n FROM r WHERE n <= 20""")
def interleave_round_robin(t):
    """Reading by (n, role) deals the roles in turn."""
    rows = t.orders.where("o_orderstatus = 'F'").select("o_orderkey", F.col("o_orderpriority").alias("role"), "o_totalprice")
    return top_n_per_group(rows, ["role"], 20, F.desc("o_totalprice"), F.asc("o_orderkey")).select("o_orderkey", "role", F.col("position").alias("n"))


@query("""SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER w AS previous, lead(o_orderkey) OVER w AS next FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice < 30000, o_totalprice DESC, o_orderkey)""")
def neighbors_prev_next(t):
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice") < 30000, F.desc("o_totalprice"), "o_orderkey")
    return t.orders.select("o_custkey", "o_orderkey", F.lag("o_orderkey").over(w).alias("previous"), F.lead("o_orderkey").over(w).alias("next"))
