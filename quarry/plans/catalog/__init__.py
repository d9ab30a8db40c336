"""Registry of runnable queries (operators bound to the test tables) and
their independent DuckDB SQL oracles.

Every query reads whole test tables (or data Spark derives from them); none
uses id subsets, modulo filters or row caps. Output columns are named
identically in the Spark plan and in the oracle SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.plans.catalog.registry import REGISTRY

# importing the family modules fills REGISTRY
from quarry.plans.catalog import (  # noqa: F401,E402
    q_sources, q_profile, q_clean, q_functions, q_joins, q_aggregates, q_windows,
    q_distributions, q_outliers, q_questions, q_features, q_models, q_metrics, q_closed_forms)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for k, v in REGISTRY.items() if v[1] is not None}
