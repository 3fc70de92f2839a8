"""Every registered query, with its SQL twin where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "retrieval_recall"

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(run):
        _QUERIES[name] = run
        if sql is not None:
            _SQL[name] = sql
        return run

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    load()
    return dict(_SQL)


def load() -> None:
    """Import the modules that register queries."""
    from folioscope.plans import contents, controls, coverage, evaluation, features, grounded, layout, memory, page_losses, retrieval, scorers, scoring, statistics, studies, training  # noqa: F401
