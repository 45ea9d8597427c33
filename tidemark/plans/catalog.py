"""Queries of the engine by name, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import replays, research, streams  # noqa: F401  they register their queries
from tidemark.plans.queries import QUERIES

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["feature_frame"][0](spark, sf_dir)
