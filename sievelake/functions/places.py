"""Places in texts: normal form of a location, countries it names, regions. Names of countries are a parameter."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievelake.functions.text import fold, squash, strip_brackets


def normal_location(raw: Column) -> Column:
    """Folded, without brackets, words for remote and outer punctuation; null if nothing is left."""
    text = F.regexp_replace(strip_brackets(fold(raw)), r"\b(?:remoto|remota|remote)\b", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"^[\s,;/|-]+|[\s,;/|-]+$", "")
    return F.nullif(squash(text), F.lit(""))


def _pattern(names: list[str], guards: dict[str, str], whole: bool) -> str:
    end = r"(?![a-z0-9])" if whole else ""
    return "|".join(rf"(?<![a-z0-9]){guards.get(n, '')}{re.escape(n)}{end}" for n in names)


def countries_mentioned(text: Column, names: dict[str, list[str]], outside: dict[str, list[str]] | None = None, guards: dict[str, str] | None = None) -> Column:
    """Codes of the countries whose names stand in a text as whole words, in the order of ``names``, then those of ``outside``.

    ``guards``: by name, a look-behind or look-ahead of its own, such as ``(?<!new )`` for mexico."""
    folded, guards = fold(F.coalesce(text, F.lit(""))), guards or {}
    every = [*names.items(), *(outside or {}).items()]
    found = [F.when(folded.rlike(_pattern(own, guards, True)), code) for code, own in every if own]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def mentions_country(text: Column, code: Column, names: dict[str, list[str]], whole: bool = True, guards: dict[str, str] | None = None) -> Column:
    """Whether a text names the country ``code``; with ``whole`` off the start of a word is enough, so that words for its people count. Unknown codes: false."""
    folded, out = fold(F.coalesce(text, F.lit(""))), F.lit(False)
    for key, own in names.items():
        if own:
            out = F.when(F.upper(code) == key, folded.rlike(_pattern(own, guards or {}, whole))).otherwise(out)
    return out


def in_regions(country: Column, regions: Column, members: dict[str, list[str]]) -> Column:
    """Whether a country belongs to one of some regions (array of names)."""
    out = F.lit(False)
    for region, codes in members.items():
        out = out | (F.array_contains(regions, region) & F.upper(country).isin(*codes))
    return F.coalesce(out, F.lit(False))
