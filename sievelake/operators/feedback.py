"""How evaluations fared: outcomes and verdicts by band of the score, the model against people's scores, and the cases that went otherwise than the score said."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: outcomes of an application
POSITIVE = ("entrevista", "oferta")
REJECTED_BY_PERSON, REJECTED_FOR_PLACE, REJECTED_BY_RULE, SILENT = "rechazo_humano", "rechazo_automatico_ubicacion", "rechazo_automatico_otro", "sin_respuesta"
AGREES, DISAGREES = "de_acuerdo", "en_desacuerdo"
#: Scores from which a band begins; below the last one, and without a score, are bands of their own.
BANDS = ((9.0, "9+"), (7.0, "7-8.9"), (5.0, "5-6.9"))
BELOW, UNKNOWN, ALL, HIGH = "<5", "no score", "all", "7+"


def band(score: Column) -> Column:
    out = F.lit(BELOW)
    for least, name in reversed(BANDS):
        out = F.when(score >= least, name).otherwise(out)
    return F.when(score.isNull(), UNKNOWN).otherwise(out)


def feedback_report(rows: DataFrame, positive: tuple[str, ...] = POSITIVE) -> DataFrame:
    """(band, evaluated, applied, positive, rejected_human, rejected_auto, no_answer, positive_rate, agree, disagree, agree_rate, pairs, mae, bias) for each band that has rows, ``all`` rows, and ``7+``.

    ``rows``: score, human_score, model, outcome (null: not applied), verdict. Verdicts and pairs of scores leave out evaluations made by people (model ``human``; an unknown model is none). Rates
    are null without a case. Each row is dealt to its bands before one grouping, so the table is read once."""
    score, machine = F.col("score"), ~F.coalesce(F.col("model") == "human", F.lit(False))
    bands = F.array_compact(F.array(band(score), F.lit(ALL), F.when(score >= 7, HIGH)))
    each = rows.select("score", "human_score", "outcome", "verdict", machine.alias("machine"), F.explode(bands).alias("band"))
    n = F.count_if
    outcome, off = F.col("outcome"), F.when(F.col("machine"), F.col("score") - F.col("human_score"))
    got = each.groupBy("band").agg(
        F.count("*").alias("evaluated"), n(outcome.isNotNull()).alias("applied"), n(outcome.isin(*positive)).alias("positive"), n(outcome == REJECTED_BY_PERSON).alias("rejected_human"), n(outcome.isin(REJECTED_FOR_PLACE, REJECTED_BY_RULE)).alias("rejected_auto"),
        n(outcome == SILENT).alias("no_answer"), n(F.col("machine") & (F.col("verdict") == AGREES)).alias("agree"), n(F.col("machine") & (F.col("verdict") == DISAGREES)).alias("disagree"), F.count(off).alias("pairs"), F.avg(F.abs(off)).alias("mae"), F.avg(off).alias("bias"),
    )
    got = got.withColumn("positive_rate", F.try_divide("positive", "applied")).withColumn("agree_rate", F.try_divide(F.col("agree"), F.col("agree") + F.col("disagree")))
    return got.select("band", "evaluated", "applied", "positive", "rejected_human", "rejected_auto", "no_answer", "positive_rate", "agree", "disagree", "agree_rate", "pairs", "mae", "bias")


def surprises(rows: DataFrame, id_col: str, positive: tuple[str, ...] = POSITIVE) -> DataFrame:
    """(id, surprise) of applications: a low score that went well, a rejection for the place where the place was said to be right, a high score without an answer."""
    score, outcome = F.col("score"), F.col("outcome")
    kinds = [
        ("low_score_positive", (score < 5) & outcome.isin(*positive)),
        ("place_rejected_though_ok", (outcome == REJECTED_FOR_PLACE) & (F.col("location_ok") == "ok")),
        ("high_score_no_answer", (score >= 7) & (outcome == SILENT)),
    ]
    return rows.select(id_col, F.explode(F.array_compact(F.array(*[F.when(holds, name) for name, holds in kinds]))).alias("surprise"))
