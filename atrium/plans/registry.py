"""Every query of the indoor-map engine by name, and its SQL for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from atrium.sources.campus import Campus, prelude

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function of the campus under its own name; ``sql`` may use the campus views and must end as a query."""

    def register(f: Callable[[Campus], DataFrame]) -> Callable[[Campus], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Campus(spark, sf_dir))
        if sql:
            text = sql.strip()
            ORACLE_SQL[f.__name__] = (prelude().rstrip() + ", " + text[1:] if text.startswith(",") else prelude() + text)
        return f

    return register


from atrium.plans import drafts, edits, flaws, geometry, graph, imdf, jobs, journeys, more, places, plan_graphs, routes, rows, upkeep, validation  # noqa: E402, F401
