"""Functions for ``spark.sql``: the scalar ones are SQL expressions that Catalyst inlines; mentions of terms are a table function."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from sievelake.functions.injection import signals_udf
from sievelake.functions.text import ACCENTED, PLAIN
from sievelake.operators.matching import term_finder

_FOLD = f"lower(translate({{}}, '{ACCENTED}', '{PLAIN}'))"
_SCALAR = {
    "fold_text(t STRING) RETURNS STRING": _FOLD.format("t"),
    "squash(t STRING) RETURNS STRING": r"trim(regexp_replace(t, r'\s+', ' '))",
    "content_hash(t STRING) RETURNS STRING": r"sha2(lower(trim(regexp_replace(t, r'\s+', ' '))), 256)",
    "word_list(t STRING) RETURNS ARRAY<STRING>": f"filter(split(regexp_replace({_FOLD.format('t')}, '[^a-z0-9]+', ' '), ' '), x -> x <> '')",
    "monthly_usd(amount DOUBLE, period STRING) RETURNS BIGINT": "CASE period WHEN 'mensual' THEN CAST(floor(amount + 0.5D) AS BIGINT) WHEN 'anual' THEN CAST(floor(amount / 12 + 0.5D) AS BIGINT) WHEN 'hora' THEN CAST(floor(amount * 160 + 0.5D) AS BIGINT) END",
    "url_host(u STRING) RETURNS STRING": "lower(regexp_extract(u, r'^[A-Za-z]+://([^/?#:]*)', 1))",
    "jaccard(a ARRAY<STRING>, b ARRAY<STRING>) RETURNS DOUBLE": "CASE WHEN size(array_union(a, b)) > 0 THEN size(array_intersect(a, b)) / size(array_union(a, b)) ELSE 0D END",
}


def register_sql(spark: SparkSession, taxonomy: list[tuple[str, list[str]]] = ()) -> list[str]:
    """Registers the functions above for the session, and ``skill_mentions(text)``, a table of (slug, position, must), to be used with LATERAL; and ``injection_signals(text)``. Their names."""
    for head, body in _SCALAR.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    find = term_finder(taxonomy)

    class Mentions:
        def eval(self, text: str) -> Iterator[tuple[str, int, bool]]:
            for slug, (at, must) in sorted(find(text or "").items()):
                yield slug, at, must

    spark.udtf.register("skill_mentions", udtf(Mentions, returnType="slug string, position long, must boolean"))
    spark.udf.register("injection_signals", signals_udf(spark))
    return [*(head.split("(")[0] for head in _SCALAR), "skill_mentions", "injection_signals"]
