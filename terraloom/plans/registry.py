"""All queries of the library's own operators, by name, with SQL counterparts."""

from __future__ import annotations

from terraloom.plans import articles, context, corpus, harmonised, meaning, measures, models, retrieval, streams, structure, warehouse, whole  # noqa: F401  they register their queries
from terraloom.plans.base import QUERIES, SQL, Query

FLAGSHIP = "m1_rank_by_sum"


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
