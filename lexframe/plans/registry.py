"""All registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexframe.plans import flows, relational, textual

_PARTS = (relational, textual, flows)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """name -> (spark, sf_dir) -> DataFrame."""
    return {name: f for part in _PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """name -> SQL over the raw tables."""
    return {name: sql for part in _PARTS for name, sql in part.SQL.items()}
