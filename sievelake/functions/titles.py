"""What a title says: levels, fit to a role, role hints. Expressions over padded words, so that a term is whole words."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievelake.functions.text import words

# fixed values: names of levels and the terms that stand for them, in order
LEVELS = (
    ("Trainee", ("intern", "internship", "trainee", "pasante", "practicante")),
    ("Junior", ("junior", "jr", "entry level")),
    ("Semi Senior", ("semi senior", "semisenior", "ssr", "mid level", "mid", "intermediate")),
    ("Senior", ("senior", "sr")),
    ("Lead", ("lead", "tech lead")),
)
# fixed values: words that lead only with a technical role, such roles, and phrases that name no level
LEAD_WITH_ROLE = ("staff", "principal")
TECHNICAL_ROLES = ("engineer", "developer", "architect", "scientist", "designer")
NO_LEVEL = ("lead generation", "lead gen", "leads", "mid market")
# fixed values: words and phrases above senior
ABOVE_SENIOR = ("staff", "principal", "head", "director", "directora", "vp", "chief", "vice president")
_GROUP = r" group (?:(?:product|engineering) )?(?:manager|lead) "


def padded(title: Column) -> Column:
    """Folded words with one blank around each."""
    return F.concat(F.lit(" "), F.array_join(words(F.coalesce(title, F.lit(""))), " "), F.lit(" "))


def _any(text: Column, terms: tuple[str, ...] | list[str]) -> Column:
    return text.rlike(" (?:" + "|".join(re.escape(t) for t in terms) + ") ") if terms else F.lit(False)


def _without(text: Column, phrases: tuple[str, ...]) -> Column:
    for p in phrases:
        text = F.regexp_replace(text, f"(?: {re.escape(p)})+ ", " ")
    return text


def title_levels(title: Column) -> Column:
    """The levels that a title names, joined by " / ", or null. "Semi senior" is no "senior"; staff and principal lead only with a technical role."""
    text = _without(padded(title), NO_LEVEL)
    rest = _without(text, ("semi senior",))
    by_role = _any(text, LEAD_WITH_ROLE) & text.rlike(f" (?:{'|'.join(TECHNICAL_ROLES)})s? ")
    found = [F.when(_any(text if name in ("Trainee", "Junior", "Semi Senior") else rest, terms) | (by_role if name == "Lead" else F.lit(False)), name) for name, terms in LEVELS]
    return F.nullif(F.array_join(F.array_compact(F.array(*found)), " / "), F.lit(""))


def title_rank(title: Column) -> Column:
    """staff_plus, senior or null."""
    text = padded(title)
    return F.when(_any(text, ABOVE_SENIOR) | text.rlike(_GROUP), "staff_plus").when(title_levels(title).isin("Senior", "Lead"), "senior")


def assess_title(title: Column, years: Column, few_years: int = 5) -> Column:
    """struct<level, senior_penalty, too_senior>: the level counts only against people of fewer than ``few_years`` known years."""
    level, few = title_rank(title), F.coalesce(years < few_years, F.lit(False))
    penalty = (few & (F.coalesce(level, F.lit("")) == "senior")).cast("int")
    return F.struct(level.alias("level"), penalty.alias("senior_penalty"), (few & (F.coalesce(level, F.lit("")) == "staff_plus")).alias("too_senior"))


def strong_pattern(terms: list[str]) -> str | None:
    """A Java pattern over raw titles for any of some terms, whole words and plurals; null without terms. Serves as a sort key."""
    parts = [r"[^\p{Alnum}]+".join(map(re.escape, t.split())) for t in dict.fromkeys(terms)]
    return rf"\b(?:{'|'.join(parts)})s?\b" if parts else None


def title_fit(title: Column, named: list[str], veto: list[str], spared: list[str] = ()) -> Column:
    """2 if a title has one of the terms ``named`` (or its plural), else 0 if it has one of ``veto`` and none of ``spared``, else 1."""
    text = padded(title)
    fits = text.rlike(" (?:" + "|".join(re.escape(t) for t in named) + ")s? ") if named else F.lit(False)
    return F.when(fits, 2).when(_any(text, veto) & ~_any(text, spared), 0).otherwise(1)


def role_hints(title: Column, category: Column, source: Column, by_category: dict[tuple[str, str], tuple[list[str], bool]], terms: dict[str, list[str]], excluded: dict[str, list[str]], most: int = 4) -> Column:
    """Roles that a posting may be for, in order of name: those of its source's category, and those whose terms its title has.

    ``by_category``: (source, category) to (roles, only with a term in the title); ``terms`` and ``excluded``: by role, terms of titles. If over ``most``
    roles come together, those of the title alone count, and none if they are still too many. Dictionaries are parameters.
    """
    text = padded(title)
    named = F.array_compact(F.array(*[F.when(_any(text, terms[r]) & ~_any(text, excluded.get(r, [])), r) for r in sorted(terms)])) if terms else F.array().cast("array<string>")
    of_category = F.array().cast("array<string>")
    for (where, what), (roles, gated) in by_category.items():
        own = F.array(*[F.lit(r) for r in roles])
        own = F.array_intersect(own, named) if gated else own
        of_category = F.when((source == where) & (F.lower(F.trim(category)) == what.lower()), own).otherwise(of_category)
    both = F.array_sort(F.array_union(of_category, named))
    return F.when(F.size(both) <= most, both).when(F.size(named) <= most, F.array_sort(named)).otherwise(F.array().cast("array<string>"))
