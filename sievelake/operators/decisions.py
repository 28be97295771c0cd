"""Decisions on scored postings: caps and penalties, actions, checklists, daily assignment, study routes, states."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def decide(score: Column, caps: list[tuple[Column, float]], penalties: list[tuple[Column, float]], blockers: Column, thresholds: dict[str, float]) -> Column:
    """struct<score, action>: the score less the penalties that hold, under the caps that hold, within 0 and 10. Blockers discard;
    else the action with the highest threshold that is reached, or discard. The score is not rounded."""
    for holds, amount in penalties:
        score = score - F.when(holds, amount).otherwise(0.0)
    for holds, cap in caps:
        score = F.when(holds, F.least(score, F.lit(cap))).otherwise(score)
    score = F.greatest(F.lit(0.0), F.least(F.lit(10.0), score))
    action = F.lit("discard")
    for name, least in sorted(thresholds.items(), key=lambda x: x[1]):
        action = F.when(score >= least, name).otherwise(action)
    return F.struct(score.alias("score"), F.when(F.size(blockers) > 0, "discard").otherwise(action).alias("action"))


def checklist(items: list[tuple[str, Column, bool]]) -> Column:
    """array<struct<item, state, blocks>> in order: met, not_met, or unknown where the test is null; only blocking items block."""
    state = lambda test: F.when(test.isNull(), "unknown").when(test, "met").otherwise("not_met")
    return F.array(*[F.struct(F.lit(n).alias("item"), state(t).alias("state"), ((state(t) == "not_met") & F.lit(b)).alias("blocks")) for n, t, b in items])


def checklist_counts(c: Column) -> Column:
    n = lambda s: F.size(F.filter(c, lambda x: x["state"] == s))
    return F.struct(n("met").alias("met"), n("not_met").alias("not_met"), n("unknown").alias("unknown"), F.exists(c, lambda x: x["blocks"]).alias("blocked"))


def assign(candidates: DataFrame, used: DataFrame, user: str, cap: int, *order: Column) -> DataFrame:
    """The best of each user's candidates, up to ``cap`` less what ``used`` (user, n) says the user had in the last day."""
    rank = F.row_number().over(Window.partitionBy(user).orderBy(*order))
    left = candidates.withColumn("position", rank).where(F.col("position") <= cap).join(used, user, "left")
    return left.where(F.col("position") <= cap - F.coalesce("n", F.lit(0))).drop("n")


def study_route(gains: DataFrame, user: str, steps: int = 5) -> DataFrame:
    """(user, step, skill, gained): greedily the skill that lets most further postings pass for each hour of study.

    ``gains``: (user, skill, hours, postings array) with the postings a skill alone would let pass. Each user's skills are few, so a user is
    one group.
    """
    kind = gains.schema[user].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = {r.skill: (r.hours if r.hours and r.hours > 0 else 20.0, set(r.postings)) for r in pdf.sort_values("skill").itertuples()}
        done, out = set(), []
        while rows and len(out) < steps:
            best = max(sorted(rows), key=lambda s: len(rows[s][1] - done) / rows[s][0])
            fresh = rows.pop(best)[1] - done
            if not fresh:
                break
            done |= fresh
            out.append((pdf[user].iloc[0], len(out) + 1, best, len(fresh)))
        return pd.DataFrame(out, columns=[user, "step", "skill", "gained"])

    return gains.groupBy(user).applyInPandas(run, f"{user} {kind}, step long, skill string, gained long")


def next_state(rows: DataFrame, transitions: dict[tuple[str, str], str]) -> DataFrame:
    """Adds ``next`` and ``valid`` to (status, event): the state a transition leads to, or the old one if there is none."""
    spark = rows.sparkSession
    known = spark.createDataFrame([(a, b, c) for (a, b), c in sorted(transitions.items())], "status string, event string, next string")
    out = rows.join(F.broadcast(known), ["status", "event"], "left")
    return out.withColumn("valid", F.col("next").isNotNull()).withColumn("next", F.coalesce("next", "status"))


def reusable(new: DataFrame, old: DataFrame, key: str, equal: list[str], newest: str) -> DataFrame:
    """(key, reason): may the latest old evaluation of a key be used again? The first of ``equal`` that differs names the reason; ``ok`` if none does,
    ``no_previous`` without one."""
    last = old.groupBy(key).agg(F.max_by(F.struct(*equal), newest).alias("was"))
    reason = F.lit("ok")
    for c in reversed(equal):
        reason = F.when(~F.col(c).eqNullSafe(F.col(f"was.{c}")), F.lit(c)).otherwise(reason)
    return new.join(last, key, "left").select(key, F.when(F.col("was").isNull(), "no_previous").otherwise(reason).alias("reason"))


# fixed values: ranks of English levels and of CEFR grades
_ENGLISH = {"basico": 1, "intermedio": 2, "avanzado": 3, "nativo": 4}
_CEFR = {"A1": 1, "A2": 1, "B1": 2, "B2": 3, "C1": 3, "C2": 4}
# fixed values: what a blocker or risk is about, over its lower-cased text
_YEARS, _DISCIPLINE, _PLACE, _WORKPLACE = r"a[ñn]os|years", r"disciplina", r"pa[ií]s|residen|ubicaci", r"presencial|h[ií]brid|oficina|on-?site"
_SALARY, _HOURS, _LANGUAGE, _INJECTED = r"salari|sueldo|remuneraci|piso", r"jornada|horas", r"ingl[eé]s|english", r"instrucciones"


@dataclass(frozen=True)
class Criteria:
    """Thresholds and penalties of ``decide_posting``; a None switches its rule off."""

    tailor: float = 9.0
    apply: float = 7.0
    save: float = 5.0
    max_years: int = 8
    years_from: int = 5
    years_to: int = 7
    years_penalty: float = 0.5
    gap_blocks_from: int | None = None
    gap_penalty_from: int | None = None
    gap_penalty: float = 0.0
    gap_risk_from: int | None = 2
    disciplines: tuple[str, ...] | None = None
    discipline_cap: float | None = 3.0
    accepted: tuple[str, ...] | None = ("remoto",)
    salary_floor: int | None = None
    max_hours: int | None = None
    cloud_penalty: float = 0.0
    english_penalty: float = 0.0
    english_risk_from: str = "avanzado"
    years: int | None = None
    cefr: str | None = None


def _about(items: Column, pattern: str) -> Column:
    return F.exists(items, lambda x: F.lower(x).rlike(pattern))


def _drop(items: Column, pattern: str) -> Column:
    return F.filter(items, lambda x: ~F.lower(x).rlike(pattern))


def _add(items: Column, holds: Column, text: Column | str, unless: str | None = None) -> Column:
    text = F.lit(text) if isinstance(text, str) else text
    holds = F.coalesce(holds, F.lit(False))
    return F.when(holds & ~_about(items, unless) if unless else holds, F.array_append(items, text)).otherwise(items)


def decide_posting(rows: DataFrame, c: Criteria) -> DataFrame:
    """Adds ``final_score``, ``blockers``, ``risks``, ``final_location_ok`` and ``action`` to evaluated postings.

    Rows have score, blockers, risks, years_required, years_discipline, discipline, modality, salary_min, salary_max, local_currency, weekly_hours, levels
    (array of the title's), english_required, english_moot, cloud_must, location_ok, title_cap, flags, only_places. Rules apply in this order: cap of the
    title, years, years of another discipline, gap of years, discipline, modality, salary, hours, level, English, infrastructure, flags, residence, remote
    work of one country only, instructions to the evaluator. Some risks only inform: they don't lower "tailor". An excluded country is saved at most.
    """
    years, own = F.col("years_required"), F.lit(c.years)
    no = F.lit(False)
    score, b, r, info = F.col("score"), F.col("blockers"), F.col("risks"), F.array().cast("array<string>")
    score = F.least(score, F.coalesce("title_cap", score))
    hard = F.coalesce(years >= c.max_years, no)
    b = _add(b, hard, F.concat(F.lit(f"años requeridos ≥ {c.max_years} ("), years.cast("string"), F.lit(")")), _YEARS)
    score = score - F.when(~hard & F.coalesce(years.between(c.years_from, c.years_to), no), c.years_penalty).otherwise(0.0)
    df = rows.withColumns({"_s": score, "_b": b, "_r": r, "_i": info})
    score, b, r, info = (F.col(x) for x in ("_s", "_b", "_r", "_i"))
    if c.disciplines is not None:
        b = _add(b, ~F.col("years_discipline").isin(*c.disciplines), F.concat(F.lit("años en otro dominio ("), "years_discipline", F.lit(")")), "otro dominio")
    gap, known = years - own, ~_about(b, _YEARS)
    at_least = lambda n: F.coalesce(gap >= n, no) & known if n is not None else no
    blocks, costs = at_least(c.gap_blocks_from), at_least(c.gap_penalty_from)
    asks = F.concat(F.lit("pide "), years.cast("string"), F.lit(f" años, tenés {c.years}"))
    r = _add(r, ~blocks & ~(costs & F.lit(c.gap_penalty > 0)) & at_least(c.gap_risk_from), asks, _YEARS)
    score = score - F.when(~blocks & costs, c.gap_penalty).otherwise(0.0)
    df = df.withColumns({"_b": _add(b, blocks, F.concat(F.lit("gap de años: "), asks)), "_s": score, "_r": r})
    score, b, r = (F.col(x) for x in ("_s", "_b", "_r"))
    if c.disciplines is not None:
        fits = F.col("discipline").isin(*c.disciplines)
        b = F.when(fits, _drop(b, _DISCIPLINE)).otherwise(_add(b, ~fits, F.concat(F.lit("disciplina distinta ("), "discipline", F.lit(")")), _DISCIPLINE))
        if c.discipline_cap is not None:
            score = F.when(fits, score).otherwise(F.least(score, F.lit(c.discipline_cap)))
    df = df.withColumns({"_s": score, "_b": b})
    if c.accepted is not None:
        typed = F.col("modality").isin("hibrido", "presencial")
        fits = F.when(typed, F.col("modality").isin(*c.accepted)).otherwise(F.lit(any(a != "remoto" for a in c.accepted)))
        moved = F.filter("_b", lambda x: F.lower(x).rlike(_WORKPLACE))
        df = df.withColumns({"_b": F.when(fits, _drop(F.col("_b"), _WORKPLACE)).otherwise(F.col("_b")), "_r": F.when(fits, F.array_union("_r", moved)).otherwise(F.col("_r"))})
    b, r, info = (F.col(x) for x in ("_b", "_r", "_i"))
    if c.salary_floor:
        low = F.col("salary_max") < c.salary_floor
        starts_low = F.coalesce(~low & (F.col("salary_min") < c.salary_floor), no)
        b = F.when(F.coalesce(~low, no), _drop(b, _SALARY)).otherwise(_add(b, low, F.concat(F.lit("salario por debajo del piso (USD "), F.col("salary_max").cast("string"), F.lit(f"/mes < {c.salary_floor})")), _SALARY))
        r, info = _add(r, starts_low, "el rango salarial empieza abajo de tu piso"), _add(info, starts_low, "el rango salarial empieza abajo de tu piso")
    local = F.coalesce("local_currency", no) & ~_about(r, r"moneda local|pesos|\bars\b")
    r, info = _add(r, local, "salario en USD pagado en moneda local"), _add(info, local, "salario en USD pagado en moneda local")
    if c.max_hours:
        b = _add(b, F.col("weekly_hours") > c.max_hours, F.concat(F.lit("jornada de "), F.col("weekly_hours").cast("string"), F.lit(f" h (máximo {c.max_hours})")), _HOURS)
    df = df.withColumns({"_b": b, "_r": r, "_i": info})
    levels = F.coalesce("levels", F.array().cast("array<string>"))
    only = lambda *names: (F.size(levels) > 0) & F.forall(levels, lambda x: x.isin(*names))
    text = F.when(only("Trainee", "Junior") & (own >= 4), f"el aviso es junior y tenés ~{c.years} años").when(only("Senior") & (own < 3), f"el aviso es senior y tenés ~{c.years} años")
    moot = F.coalesce("english_moot", no)
    df = df.withColumns({"_r": _add(F.col("_r"), text.isNotNull(), text), "_i": _add(F.col("_i"), text.isNotNull(), text)})
    demoted = moot & _about(F.col("_b"), _LANGUAGE)
    df = df.withColumns({"_b": F.when(moot, _drop(F.col("_b"), _LANGUAGE)).otherwise(F.col("_b")), "_r": _add(F.when(moot, _drop(F.col("_r"), _LANGUAGE)).otherwise(F.col("_r")), demoted, "el aviso no pide inglés, el modelo sí")})
    rank = F.create_map(*[F.lit(x) for kv in _ENGLISH.items() for x in kv])
    asked, mine = F.try_element_at(rank, F.coalesce("english_required", F.lit(""))), _CEFR.get((c.cefr or "").upper())
    short = F.lit(True) if mine is None else F.coalesce(asked > mine, no)
    score = F.col("_s") - F.when(F.coalesce("cloud_must", no), c.cloud_penalty).otherwise(0.0)
    score = score - F.when(~moot & F.col("english_required").isin("avanzado", "nativo") & short, c.english_penalty).otherwise(0.0)
    risky = (asked >= _ENGLISH[c.english_risk_from]) & (asked > mine) & ~moot if mine is not None else no
    r = _add(F.col("_r"), risky, F.concat(F.lit("inglés requerido "), "english_required", F.lit(f", el candidato tiene {c.cefr}")), _LANGUAGE)
    flags = F.coalesce("flags", F.array().cast("array<string>"))
    r = _add(r, F.array_contains(flags, "location_risk"), "ubicación sin confirmar", r"pa[ií]s|latam|ubicaci")
    r = _add(r, F.array_contains(flags, "many_candidates"), "muchos candidatos", "candidatos")
    df = df.withColumns({"_s": score, "_r": r})
    r = _add(F.col("_r"), F.col("location_ok") != "ok", F.concat(F.lit("location_ok = "), "location_ok"), r"pa[ií]s|latam|ubicaci")
    residence = F.try_element_at(F.filter(flags, lambda f: f.startswith("residencia_exigida:")), F.lit(1))
    b = _add(F.col("_b"), residence.isNotNull(), F.concat(F.lit("residencia exigida en "), F.replace(F.substring(residence, 20, 10_000), F.lit(","), F.lit(", "))), _PLACE)
    limited = residence.isNull() & F.col("only_places").isNotNull()
    b = _add(b, limited, F.concat(F.lit("remoto solo desde "), "only_places"), _PLACE)
    place = F.when(residence.isNotNull() | limited, "no").otherwise(F.col("location_ok"))
    injected = _about(F.col("_r"), _INJECTED) | F.array_contains(flags, "injection")
    df = df.withColumns({"_r": F.when(injected, F.array_append(_drop(r, _INJECTED), F.lit("el aviso trae instrucciones al evaluador"))).otherwise(r), "_b": b, "final_location_ok": place, "_injected": injected})
    final = F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.when(F.col("_injected"), F.least("_s", F.lit(c.save))).otherwise(F.col("_s"))))
    df = df.withColumns({"final_score": F.round(final, 2)})
    s, telling = F.col("final_score"), F.size(F.array_except("_r", "_i")) > 0
    action = (
        F.when((F.size("_b") > 0) | (s < c.save), "descartar")
        .when(telling, F.when(s >= c.apply, "aplicar").otherwise("guardar"))
        .when(s >= c.tailor, "aplicar_personalizado")
        .when(s >= c.apply, "aplicar")
        .otherwise("guardar")
    )
    held = ((F.col("final_location_ok") == "no") | F.col("_injected")) & action.startswith("aplicar")
    df = df.withColumns({"action": F.when(held, "guardar").otherwise(action), "blockers": F.col("_b"), "risks": F.col("_r")})
    return df.drop("_s", "_b", "_r", "_i", "_injected")


def recompute_allowed(now: Column, last: Column, changed: Column, floor_s: int = 10, window_s: int = 600) -> Column:
    """ok, or why a costly result is not made anew: floor (seconds ago, or a clock that went back) or window (inputs unchanged). Times in seconds."""
    past = now - last
    return F.when(last.isNull(), "ok").when(past < floor_s, "floor").when(changed, "ok").when(past < window_s, "window").otherwise("ok")


def progress(status: Column, action: Column, acted: tuple[str, ...]) -> tuple[Column, Column]:
    """(recommended, reviewed) as aggregates: only what was recommended counts, and of it what has been acted on."""
    green = action.isin("aplicar", "aplicar_personalizado")
    return F.count_if(green), F.count_if(green & status.isin(*acted))


def stratified_split(rows: DataFrame, id_col: str, strata: list[str], seed: int) -> DataFrame:
    """(id, part) with part dev or test: within each stratum rows are shuffled by a seeded hash and dealt in turn, and strata with an odd number give their
    last row to the parts in turn, so that parts differ by one at most. Both depend on ids and seed alone."""
    shuffled = rows.withColumn("_place", F.row_number().over(Window.partitionBy(*strata).orderBy(F.xxhash64(F.lit(seed), id_col), id_col)) - 1)
    sizes = rows.groupBy(*strata).agg(F.count("*").alias("_n"))
    # one row for each stratum
    odd = sizes.withColumn("_odd", F.sum(F.col("_n") % 2).over(Window.orderBy(*strata).rowsBetween(Window.unboundedPreceding, -1))).drop("_n")
    placed = shuffled.join(F.broadcast(odd), strata)
    return placed.select(id_col, F.when((F.col("_place") + F.coalesce("_odd", F.lit(0))) % 2 == 0, "dev").otherwise("test").alias("part"))
