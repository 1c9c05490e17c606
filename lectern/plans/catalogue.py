"""All core queries with their SQL."""

from lectern.plans import core_queries, drift_queries, response_queries  # noqa: F401 - registers its queries with the core ones

QUERIES = {**core_queries.QUERIES, **drift_queries.QUERIES}
ORACLE: dict[str, str] = {**core_queries.ORACLE, **drift_queries.ORACLE}
