"""Feedback on evaluations: every order as an evaluated posting."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievelake.operators import feedback
from sievelake.plans.registry import query

_ROWS = """r AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 19 > 0 THEN round(o_totalprice / 50000, 1) END AS score, CASE WHEN o_orderkey % 4 = 0 THEN round(o_totalprice / 60000, 1) END AS human, CASE WHEN o_orderkey % 11 = 0 THEN 'human' WHEN o_orderkey % 7 > 0 THEN 'm1' END AS model,
  CASE o_orderkey % 8 WHEN 0 THEN 'entrevista' WHEN 1 THEN 'oferta' WHEN 2 THEN 'rechazo_humano' WHEN 3 THEN 'rechazo_automatico_ubicacion' WHEN 4 THEN 'rechazo_automatico_otro' WHEN 5 THEN 'sin_respuesta' END AS outcome, CASE o_orderkey % 5 WHEN 0 THEN 'de_acuerdo' WHEN 1 THEN 'en_desacuerdo' END AS verdict, CASE WHEN o_orderstatus = 'F' THEN 'ok' ELSE 'no' END AS place FROM orders)"""


def _evaluated(t):
    key = F.col("o_orderkey")
    outcomes = ("entrevista", "oferta", "rechazo_humano", "rechazo_automatico_ubicacion", "rechazo_automatico_otro", "sin_respuesta")
    outcome = F.coalesce(*[F.when(key % 8 == k, name) for k, name in enumerate(outcomes)])
    return t.orders.select(
        key.alias("id"), F.when(key % 19 > 0, F.round(F.col("o_totalprice") / 50000, 1)).alias("score"), F.when(key % 4 == 0, F.round(F.col("o_totalprice") / 60000, 1)).alias("human_score"), F.when(key % 11 == 0, "human").when(key % 7 > 0, "m1").alias("model"),
        outcome.alias("outcome"), F.when(key % 5 == 0, "de_acuerdo").when(key % 5 == 1, "en_desacuerdo").alias("verdict"), F.when(F.col("o_orderstatus") == "F", "ok").otherwise("no").alias("location_ok"),
    )


@query(f"""WITH {_ROWS}, b AS (SELECT *, unnest(list_filter([CASE WHEN score IS NULL THEN 'no score' WHEN score >= 9 THEN '9+' WHEN score >= 7 THEN '7-8.9' WHEN score >= 5 THEN '5-6.9' ELSE '<5' END, 'all', CASE WHEN score >= 7 THEN '7+' END], lambda x: x IS NOT NULL)) AS band, model IS DISTINCT FROM 'human' AS machine FROM r)
  SELECT band, count(*) AS evaluated, count(outcome) AS applied, count(*) FILTER (outcome IN ('entrevista', 'oferta')) AS positive, count(*) FILTER (outcome = 'rechazo_humano') AS rejected_human, count(*) FILTER (outcome LIKE 'rechazo_automatico%') AS rejected_auto, count(*) FILTER (outcome = 'sin_respuesta') AS no_answer,
  count(*) FILTER (outcome IN ('entrevista', 'oferta')) / CAST(nullif(count(outcome), 0) AS DOUBLE) AS positive_rate, count(*) FILTER (machine AND verdict = 'de_acuerdo') AS agree, count(*) FILTER (machine AND verdict = 'en_desacuerdo') AS disagree,
  count(*) FILTER (machine AND verdict = 'de_acuerdo') / CAST(nullif(count(*) FILTER (machine AND verdict IS NOT NULL), 0) AS DOUBLE) AS agree_rate, count(score - human) FILTER (machine) AS pairs, round(avg(abs(score - human)) FILTER (machine), 6) AS mae, round(avg(score - human) FILTER (machine), 6) AS bias FROM b GROUP BY 1""")
def feedback_report(t):
    return feedback.feedback_report(_evaluated(t)).withColumns({c: F.round(c, 6) for c in ("mae", "bias")})


@query(f"""WITH {_ROWS} SELECT id, unnest(list_filter([CASE WHEN score < 5 AND outcome IN ('entrevista', 'oferta') THEN 'low_score_positive' END, CASE WHEN outcome = 'rechazo_automatico_ubicacion' AND place = 'ok' THEN 'place_rejected_though_ok' END, CASE WHEN score >= 7 AND outcome = 'sin_respuesta' THEN 'high_score_no_answer' END], lambda x: x IS NOT NULL)) AS surprise FROM r""")
def feedback_surprises(t):
    return feedback.surprises(_evaluated(t), "id")
