"""Engagement aggregates over the run-outcome events.

Scale design: every distinct-count of the reference (distinct days per user, distinct
users per day / status / source) is computed by first aggregating to the distinct
``(group, user[, day])`` pairs -- a partial (map-side) aggregation that collapses a hot
user's rows to at most one row per day before the first shuffle -- and then counting
those pairs.  No ``COUNT(DISTINCT)`` Expand, no window over raw events.  All period
bounds are multiples of a day, so conditions on ``created_at`` are equivalent to
conditions on the day number and the pre-aggregate is exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.functions.clock import DAY, Clock, day_of, in_range
from meterline.functions.daybits import day_count, day_maps

RUN_EVENTS = ("run_succeeded", "run_failed")


def _as_int(c):
    return c.cast("int")


def weight(df: DataFrame):
    """Row weight: 1 for event rows, ``n`` for pre-aggregated rollup rows (same columns
    plus a count ``n``), so every operator here runs on raw events or on the rollup."""
    return F.col("n") if "n" in df.columns else F.lit(1)


def run_outcomes(events: DataFrame, lo: int, hi: int) -> DataFrame:
    """authenticated run outcomes with ``lo <= created_at < hi``."""
    return events.where(F.col("event_name").isin(*RUN_EVENTS) & F.col("user_id").isNotNull()
                        & in_range("created_at", lo, hi))


def successes(events: DataFrame, lo: int, hi: int) -> DataFrame:
    return events.where((F.col("event_name") == "run_succeeded") & F.col("user_id").isNotNull()
                        & in_range("created_at", lo, hi))


def _user_days(df: DataFrame, *keys: str) -> DataFrame:
    """Distinct (keys..., user_id, day) with attempts / successes per cell."""
    w = weight(df)
    return (df.withColumn("day", day_of("created_at"))
            .groupBy(*keys, "user_id", "day")
            .agg(F.sum(w).alias("n_attempts"),
                 F.sum(w * _as_int(F.col("event_name") == "run_succeeded")).alias("n_runs")))


def weekly_repeat_users(events: DataFrame, c: Clock) -> DataFrame:
    """A2: repeat users over the last two complete 7-day windows (north-star metric).

    One shuffle by user: each user's success days of a week are a bit map in one long,
    combined map-side, so neither a (user, day) shuffle nor a set of days is needed."""
    per_user = (successes(events, c.end - 14 * DAY, c.end).groupBy("user_id")
                .agg(*day_maps("this", c.end_day - 7, 7), *day_maps("last", c.end_day - 14, 7))
                .select(day_count("this", 7).alias("this_week"), day_count("last", 7).alias("last_week")))
    tw, lw = F.col("this_week"), F.col("last_week")

    def n(pred):
        return F.coalesce(F.sum(_as_int(pred)), F.lit(0)).cast("long")

    return per_user.agg(
        n(tw > 0).alias("active"),
        n(tw >= 2).alias("repeat_users"),
        n(lw >= 2).alias("previous_repeat_users"),
        n(lw > 0).alias("previous_active"),
        n((lw > 0) & (tw > 0)).alias("retained"),
        n((lw > 0) & (tw == 0)).alias("lapsed"))


def period_engagement(events: DataFrame, c: Clock) -> DataFrame:
    """A1 + F3: current vs previous period; a period without rows reports zeros.

    One shuffle by user: attempts/runs per period are conditional sums and the distinct
    success days of a period are bit maps of at most 90 days."""
    spark = events.sparkSession
    runs = run_outcomes(events, c.previous_start, c.end)
    w = weight(runs)
    cur = F.col("created_at") >= F.lit(c.start)
    ok = F.col("event_name") == "run_succeeded"
    per_user = runs.groupBy("user_id").agg(
        F.sum(F.when(cur, w)).alias("a_c"), F.sum(F.when(~cur, w)).alias("a_p"),
        F.sum(F.when(cur & ok, w).otherwise(0)).alias("r_c"), F.sum(F.when(~cur & ok, w).otherwise(0)).alias("r_p"),
        *day_maps("d_c", c.start_day, c.days, ok), *day_maps("d_p", c.previous_start_day, c.days, ok))
    rows = per_user.select(F.explode(F.array(
        F.struct(F.lit("current").alias("period"), F.col("a_c").alias("attempts"), F.col("r_c").alias("runs"),
                 day_count("d_c", c.days).alias("active_days")),
        F.struct(F.lit("previous").alias("period"), F.col("a_p").alias("attempts"), F.col("r_p").alias("runs"),
                 day_count("d_p", c.days).alias("active_days")))).alias("p")).select("p.*").where(F.col("attempts").isNotNull())
    per_period = rows.groupBy("period").agg(
        F.sum("attempts").alias("attempts"), F.sum("runs").alias("runs"),
        F.sum(_as_int(F.col("runs") > 0)).alias("active"),
        F.sum(_as_int(F.col("active_days") >= 2)).alias("repeat_users"),
        F.sum("active_days").alias("active_days"))
    spine = spark.createDataFrame([("current",), ("previous",)], "period string")
    cols = ["attempts", "runs", "active", "repeat_users", "active_days"]
    return (spine.join(F.broadcast(per_period), "period", "left")
            .select("period", *[F.coalesce(F.col(x), F.lit(0)).cast("long").alias(x) for x in cols]))


def daily_series(events: DataFrame, c: Clock, tracking_since: int) -> DataFrame:
    """A3 + J21 + F24: one row per day of the period, zeros where empty, ``covered`` flag."""
    spark = events.sparkSession
    cells = _user_days(run_outcomes(events, c.start, c.end))
    per_day = cells.groupBy("day").agg(
        F.sum("n_runs").alias("runs"),
        (F.sum("n_attempts") - F.sum("n_runs")).alias("failures"),
        F.sum(_as_int(F.col("n_runs") > 0)).alias("active"))
    spine = spark.range(c.start_day, c.end_day).withColumnRenamed("id", "day")
    return (spine.join(F.broadcast(per_day), "day", "left")
            .select("day", (F.col("day") * DAY).alias("time"),
                    (F.col("day") * DAY >= F.lit(tracking_since)).alias("covered"),
                    *[F.coalesce(F.col(x), F.lit(0)).cast("long").alias(x)
                      for x in ("runs", "failures", "active")])
            .orderBy("day"))


def failures_by_status(events: DataFrame, c: Clock) -> DataFrame:
    """A11 + F8: failed runs by status (NULL status is its own group), attempts desc."""
    failed = events.where((F.col("event_name") == "run_failed") & F.col("user_id").isNotNull()
                          & in_range("created_at", c.start, c.end))
    per_user = failed.groupBy("status", "user_id").agg(F.sum(weight(failed)).alias("n"))
    return (per_user.groupBy("status")
            .agg(F.sum("n").alias("attempts"), F.count(F.lit(1)).alias("users"))
            .orderBy(F.desc("attempts"), F.asc_nulls_last("status")))


def credit_blocked_users(events: DataFrame, c: Clock) -> DataFrame:
    """Distinct users blocked by insufficient credit (status 402), 0 when none."""
    by_status = failures_by_status(events, c)
    return by_status.agg(
        F.coalesce(F.sum(F.when(F.col("status") == 402, F.col("users"))), F.lit(0))
        .cast("long").alias("credit_blocked_users"))


def sources(events: DataFrame, c: Clock) -> DataFrame:
    """Outcomes by request source; NULL source reported as 'unknown', runs desc."""
    runs = run_outcomes(events, c.start, c.end).withColumn(
        "source", F.coalesce(F.col("source"), F.lit("unknown")))
    w = weight(runs)
    per_user = runs.groupBy("source", "user_id").agg(
        F.sum(w).alias("n"),
        F.sum(w * _as_int(F.col("event_name") == "run_succeeded")).alias("r"))
    return (per_user.groupBy("source")
            .agg(F.sum("n").alias("attempts"), F.sum("r").alias("runs"),
                 F.sum(_as_int(F.col("r") > 0)).alias("users"))
            .orderBy(F.desc("runs"), F.asc("source")))


def today(events: DataFrame, c: Clock) -> DataFrame:
    """The partial current day ``[end, now]`` (inclusive of ``now``)."""
    part = events.where(F.col("event_name").isin(*RUN_EVENTS) & F.col("user_id").isNotNull()
                        & (F.col("created_at") >= F.lit(c.end))
                        & (F.col("created_at") <= F.lit(c.now)))
    w = weight(part)
    per_user = part.groupBy("user_id").agg(
        F.sum(w).alias("n"),
        F.sum(w * _as_int(F.col("event_name") == "run_succeeded")).alias("r"),
        F.max("created_at").alias("last"))
    return per_user.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("attempts"),
        F.coalesce(F.sum("r"), F.lit(0)).cast("long").alias("runs"),
        F.count(F.when(F.col("r") > 0, 1)).cast("long").alias("active"),
        F.max("last").alias("last_event"))


def approx_active_users(events: DataFrame, c: Clock, rsd: float = 0.01) -> DataFrame:
    """A16 (opt-in approximate form): distinct successful users per day with HyperLogLog++
    (``approx_count_distinct``, relative standard deviation ``rsd``).  The exact forms
    above are the default; this trades exactness for one pass with no user-level shuffle."""
    ok = successes(events, c.start, c.end)
    return (ok.groupBy(day_of("created_at").alias("day"))
            .agg(F.approx_count_distinct("user_id", rsd).alias("active_approx")))
