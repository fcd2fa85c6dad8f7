"""All queries of the engine by name, with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tactus.plans import checks, grids, signals, stores, tempos, texts  # noqa: F401 (they register their queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.grid_score(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(grids.Q)


def oracle_sql() -> dict[str, str]:
    return dict(grids.SQL)
