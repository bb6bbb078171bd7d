"""Feature table (A4, A5, J4, J5, W1-W3, K1): per-slug usage, repeat people and P95 latency.

P95 is nearest-rank: the value at ``rank = (95 * n + 99) div 100`` of the slug's
successful durations in ascending order.  The reference numbers the rows with
``ROW_NUMBER() OVER (PARTITION BY slug ORDER BY duration_ms)`` which, at scale, sorts
every event of a slug inside one task (one hot slug = one straggler).  Here the rows
are first counted per ``(slug, duration_ms)`` (map-side partial aggregation), and the
running count runs over that histogram, whose size is bounded by the number of distinct
durations, not by the number of events.  The first duration whose cumulative count
reaches the rank is exactly the ``rank``-th value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterline.functions.clock import Clock, day_of
from meterline.functions.daybits import day_count, day_maps
from meterline.operators.engagement import run_outcomes, weight


def _as_int(c):
    return c.cast("int")


def nearest_rank_percentile(df: DataFrame, key: str, value: str, pct: int = 95,
                            out: str = "p95_ms") -> DataFrame:
    """Exact nearest-rank percentile of ``value`` per ``key`` via a value histogram."""
    hist = (df.where(F.col(value).isNotNull())
            .groupBy(key, value).agg(F.sum(weight(df)).alias("cnt")))
    w_run = Window.partitionBy(key).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    w_all = Window.partitionBy(key)
    ranked = (hist.withColumn("cum", F.sum("cnt").over(w_run))
              .withColumn("n", F.sum("cnt").over(w_all))
              .withColumn("target", F.expr(f"({pct} * n + 99) div 100")))
    return (ranked.where(F.col("cum") >= F.col("target"))
            .groupBy(key).agg(F.min(value).alias(out), F.first("n").alias("n")))


def people_days(runs: DataFrame) -> DataFrame:
    """A5: (slug, user_id) -> distinct success days."""
    return (runs.where(F.col("event_name") == "run_succeeded")
            .select("slug", "user_id", day_of("created_at").alias("day")).distinct()
            .groupBy("slug", "user_id").agg(F.count(F.lit(1)).alias("days")))


def feature_p95(events: DataFrame, c: Clock) -> DataFrame:
    """Nearest-rank P95 of successful durations per slug, with the sample size."""
    runs = run_outcomes(events, c.start, c.end).where(F.col("event_name") == "run_succeeded")
    return nearest_rank_percentile(runs, "slug", "duration_ms").select(
        "slug", F.col("n").cast("long").alias("n"), F.col("p95_ms").cast("long").alias("p95_ms"))


def feature_table(events: DataFrame, c: Clock, latency: DataFrame | None = None) -> DataFrame:
    """A4: slug, attempts, runs, users, credit_blocks, repeat_users, p95_ms (users desc, runs desc).

    ``latency``: optional (slug, duration_ms, n) histogram of the period's successes, for
    when ``events`` is a rollup without durations."""
    runs = run_outcomes(events, c.start, c.end)
    w = weight(runs)
    ok = F.col("event_name") == "run_succeeded"
    # One shuffle by (slug, user): distinct success days are bit maps of the period.
    per_user = (runs.groupBy("slug", "user_id")
                .agg(F.sum(w).alias("a"), F.sum(w * _as_int(ok)).alias("r"),
                     F.sum(w * _as_int(F.col("status") == 402)).alias("b"),
                     *day_maps("d", c.start_day, c.days, ok))
                .withColumn("days", day_count("d", c.days)))
    per_slug = per_user.groupBy("slug").agg(
        F.sum("a").cast("long").alias("attempts"),
        F.sum("r").cast("long").alias("runs"),
        F.sum(_as_int(F.col("r") > 0)).cast("long").alias("users"),
        F.sum("b").cast("long").alias("credit_blocks"),
        F.sum(_as_int(F.col("days") >= 2)).cast("long").alias("repeat_users"))
    p95 = nearest_rank_percentile(latency if latency is not None else
                                  runs.where(F.col("event_name") == "run_succeeded"),
                                  "slug", "duration_ms").select("slug", "p95_ms")
    # Left join on '=' -- a NULL slug never matches, so its P95 stays NULL.
    return (per_slug.join(p95, "slug", "left")
            .select("slug", "attempts", "runs", "users", "credit_blocks",
                    F.when(F.col("slug").isNull(), F.lit(0)).otherwise(F.col("repeat_users"))
                    .cast("long").alias("repeat_users"),
                    F.col("p95_ms").cast("long").alias("p95_ms"))
            .orderBy(F.desc("users"), F.desc("runs"), F.asc_nulls_last("slug")))
