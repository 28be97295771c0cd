"""Shingles, sketches and set similarity as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievelake.functions.text import words


def shingles(text: Column, n: int = 5) -> Column:
    """Distinct ``n``-word sequences; a text of ``n`` words or fewer is one; none for a text without words."""

    def of(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
        one = F.array(F.array_join(w, " "))
        return F.when(F.size(w) > n, F.array_distinct(many)).when(F.size(w) > 0, one).otherwise(F.array().cast("array<string>"))

    # bound as a lambda's variable, the words are found once and not again for each shingle
    return F.element_at(F.transform(F.array(words(text)), of), 1)


def jaccard(a: Column, b: Column) -> Column:
    """Share of common members; 0 for two empty sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def fnv1a(text: Column) -> Column:
    """FNV-1a, 32 bits, over the code points below 128 (others count by their first byte's code)."""
    start, prime, low = F.lit(2166136261), F.lit(16777619), F.lit(4294967295)
    return F.aggregate(
        F.transform(F.filter(F.split(text, ""), lambda c: c != ""), F.ascii),
        start.cast("long"),
        lambda h, c: (h.bitwiseXOR(c.cast("long")) * prime).bitwiseAND(low),
    )


def sketch(text: Column, k: int = 512, n: int = 5) -> Column:
    """The ``k`` least distinct shingle hashes, in order."""
    return F.slice(F.array_sort(F.array_distinct(F.transform(shingles(text, n), fnv1a))), 1, k)


def sketch_similarity(a: Column, b: Column, k: int = 512) -> Column:
    """Share of the ``k`` least hashes of both that are in each; equals Jaccard up to ``k`` shingles."""
    least = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    both = F.size(F.array_intersect(F.array_intersect(least, a), b))
    return F.when(F.size(least) > 0, both / F.size(least)).otherwise(F.lit(0.0))
