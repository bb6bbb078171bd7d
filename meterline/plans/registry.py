"""Query registry: every named query as ``(spark, sf_dir) -> DataFrame`` plus its oracle SQL.

Queries read the driver tables (or views Spark derives from them) in full; the only
parameters are the fixed reporting clocks below, which place "today" inside the
events' date range.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}

# Fixed reporting clocks (epoch ms, UTC).
NOW = 1_706_637_600_000          # 2024-01-30T18:00Z: today has rows, periods end 2024-01-30
COHORT_NOW = 1_707_955_200_000   # 2024-02-15T00:00Z: 90-day cohorts with matured 35-day rules
TRACKING_SINCE = 1_704_067_200_000  # 2024-01-01T00:00Z


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    import importlib
    for mod in MODULES:
        importlib.import_module(f"meterline.plans.{mod}")


MODULES = ["q_engagement", "q_money", "q_pricing", "q_ledger", "q_purchases", "q_metering", "q_privacy", "q_text", "q_kpi", "q_streaming"]


def reset_caches(spark: SparkSession) -> None:
    """Drop every materialised intermediate (memoised tables and Spark's cache), so the
    next query run computes from the source tables again (used between bench runs)."""
    from meterline.plans import q_privacy
    q_privacy._T._memo.clear()
    spark.catalog.clearCache()
