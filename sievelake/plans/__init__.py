"""Named queries on the driver tables, each beside its DuckDB statement."""

from sievelake.plans import activity, decisions, live, market, more, outcomes, reports, rules, selection, texts, weekly  # noqa: F401
from sievelake.plans.registry import ORACLE, QUERIES


def all_queries() -> dict:
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    return dict(ORACLE)
