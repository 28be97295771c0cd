"""Terms in texts: taxonomy mentions and location scopes."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.functions.text import fold


def compile_terms(taxonomy: list[tuple[str, list[str]]]) -> list[tuple[str, str]]:
    """(term, slug) from (slug, names), longest term first; of equal terms the first slug in order stays."""
    found: dict[str, str] = {}
    for slug, names in taxonomy:
        for name in names:
            found.setdefault(" ".join(name.lower().split()), slug)
    return sorted(((t, s) for t, s in found.items() if t), key=lambda x: (-len(x[0]), x[0]))


def term_finder(taxonomy: list[tuple[str, list[str]]]) -> Callable[[str], dict[str, tuple[int, bool]]]:
    """A function from a text to slug: (first position, must). Longer terms come first and take what they cover, so that a shorter term inside a longer one
    doesn't count. ``must``: some mention stands in a line without a word of choice ("nice to have", "a plus"). Terms that a text lacks cost a substring search."""
    terms = [(t, re.compile(rf"(?<![\w+#]){re.escape(t)}(?![\w+#])"), s) for t, s in compile_terms(taxonomy)]
    optional = re.compile(r"nice to have|a plus|desirable|deseable|preferred|optional")

    def find(text: str) -> dict[str, tuple[int, bool]]:
        low, found = text.lower(), {}
        taken = bytearray(len(low))
        for term, pattern, slug in terms:
            if term not in low:
                continue
            for m in pattern.finditer(low):
                a, b = m.span()
                if any(taken[a:b]):
                    continue
                taken[a:b] = b"\1" * (b - a)
                at, must = found.get(slug, (a, False))
                if not must:
                    line = low[low.rfind("\n", 0, a) + 1 : (low.find("\n", b) + 1 or len(low) + 1) - 1]
                    must = optional.search(line) is None
                found[slug] = (min(at, a), must)
        return found

    return find


def mentions(docs: DataFrame, taxonomy: list[tuple[str, list[str]]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, slug, position, must): the first mention of each slug in a text (see ``term_finder``). No single expression lets longer terms take what they
    cover, hence Arrow batches. The taxonomy is a dimension of bounded size and travels with the function.
    """
    find, kind = term_finder(taxonomy), docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, slug, at, must) for k, t in enumerate(batch.column(1).to_pylist()) if t for slug, (at, must) in sorted(find(t).items())]
            at, slug, position, must = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(slug, pa.string()), pa.array(position, pa.int64()), pa.array(must, pa.bool_())], [id_col, "slug", "position", "must"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, slug string, position long, must boolean")


def location_scope(raw: Column, allowed: Column, phrases: dict[str, list[str]]) -> Column:
    """struct<kind, countries>: any, places or unknown.

    ``allowed``: country codes (``*`` means any; null unknown), which win over the text. ``phrases``: folded phrases and the codes they
    stand for; longer ones are looked for first and cut out, so that a phrase inside a longer one doesn't count. A word that names a
    time zone makes the scope unknown.
    """
    left = F.concat(F.lit(" "), F.regexp_replace(fold(F.coalesce(raw, F.lit(""))), "[^a-z0-9]+", "  "), F.lit(" "))
    zone = left.rlike(r" (utc|gmt|est|pst|cet|timezone|timezones|time zone) ")
    codes = F.array().cast("array<string>")
    for phrase in sorted(phrases, key=lambda p: (-len(p), p)):
        inside = r" +".join(re.escape(w) for w in phrase.split())
        hit = left.rlike(f" {inside} ")
        codes = F.when(hit, F.array_union(codes, F.array(*[F.lit(c) for c in phrases[phrase]]))).otherwise(codes)
        left = F.regexp_replace(left, f" {inside} ", " ")
    known = F.filter(allowed, lambda c: c.isNotNull())
    none = F.lit(None).cast("array<string>")
    scope = lambda kind, countries: F.struct(F.lit(kind).alias("kind"), countries.alias("countries"))
    return (
        F.when(F.array_contains(known, "*"), scope("any", none))
        .when(F.size(known) > 0, scope("places", F.array_sort(known)))
        .when(zone | (F.size(codes) == 0), scope("unknown", none))
        .when(F.array_contains(codes, "*"), scope("any", none))
        .otherwise(scope("places", F.array_sort(codes)))
    )


def allows_country(scope: Column, country: Column) -> Column:
    """True unless the scope names places without the country."""
    return F.when((scope["kind"] == "places") & country.isNotNull(), F.array_contains(scope["countries"], country)).otherwise(True)
