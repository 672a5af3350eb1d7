"""All registered queries: name, callable and SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

FAMILIES = (
    "evidence_plans", "metric_plans", "snapshot_plans", "split_plans", "variance_plans", "vector_plans", "source_plans", "statistics_plans", "report_plans", "stream_plans",
)

_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under the operator's id, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        if name in _queries:
            raise ValueError(f"two queries are named {name}")
        _queries[name] = f
        if sql is not None:
            _oracles[name] = sql
        return f

    return add


def _load() -> None:
    for family in FAMILIES:
        importlib.import_module(f"corroborate.plans.{family}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracles() -> dict[str, str]:
    _load()
    return dict(_oracles)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["AGG07"](spark, sf_dir)
