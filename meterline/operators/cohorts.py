"""Account lifecycle and weekly signup cohorts.

Windows are signup-relative and millisecond-exact: activation needs a first success
strictly before ``signup + 7d``; week-1 return is ``[+7d, +14d)``, week-4 ``[+28d, +35d)``;
maturity is inclusive (``created_at <= end - N``).  Cohort users are those with
``created_at in [max(start, tracking_since), end)``.

Plan: the success events (two columns) are inner-joined to the cohort users on
``user_id`` with the range predicate, aggregated per user on the join's own
partitioning, then left-joined back so users without a success keep NULLs.  An inner
equi-join lets AQE's skew rule split a hot user's partition (a left join cannot split
its right side).  First-paid is pre-aggregated per user before it meets the users.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.functions.clock import DAY, Clock
from meterline.operators.money import first_purchases, paid_ledger

COHORT_COLUMNS = ["signups", "eligible7", "activated7", "activation_ms", "eligible14", "retained14",
                  "eligible35", "retained35", "eligible30", "paid30"]


def monday_week(ms_col: str) -> F.Column:
    """ISO date (text) of the Monday on or before the UTC day of ``ms_col``."""
    return F.date_format(F.date_trunc("week", F.timestamp_millis(F.col(ms_col))), "yyyy-MM-dd")


def account_lifecycle(users: DataFrame, events: DataFrame, ledger: DataFrame, store_tx: DataFrame,
                      c: Clock, tracking_since: int) -> DataFrame:
    """Id, created_at, first_run, returned_week1, returned_week4, first_paid."""
    cohort_start = max(c.start, tracking_since)
    u = users.where((F.col("created_at") >= F.lit(cohort_start)) & (F.col("created_at") < F.lit(c.end)))
    ev = (events.where((F.col("event_name") == "run_succeeded") & F.col("user_id").isNotNull()
                       & (F.col("created_at") >= F.lit(cohort_start)) & (F.col("created_at") < F.lit(c.end)))
          .select("user_id", F.col("created_at").alias("t")))
    uj = u.select(F.col("id").alias("user_id"), F.col("created_at").alias("signup"))
    t, s = F.col("t"), F.col("signup")
    runs = (uj.join(ev, "user_id", "inner").where(t >= s)
            .groupBy("user_id")
            .agg(F.min("t").alias("first_run"),
                 F.max(((t >= s + 7 * DAY) & (t < s + 14 * DAY)).cast("int")).alias("returned_week1"),
                 F.max(((t >= s + 28 * DAY) & (t < s + 35 * DAY)).cast("int")).alias("returned_week4")))
    paid = first_purchases(paid_ledger(ledger, store_tx))
    return (u.join(runs, u["id"] == runs["user_id"], "left").drop("user_id")
            .join(paid, u["id"] == paid["user_id"], "left").drop("user_id")
            .select("id", "created_at", "first_run", "returned_week1", "returned_week4", "first_paid"))


def signup_cohorts(accounts: DataFrame, c: Clock) -> DataFrame:
    """One row per Monday week of signup."""
    ca, fr, fp = F.col("created_at"), F.col("first_run"), F.col("first_paid")

    def mature(n):
        return ca <= F.lit(c.end - n * DAY)

    act = fr < ca + 7 * DAY

    def n_if(cond):
        return F.sum(F.when(cond, 1).otherwise(0)).cast("long")

    return (accounts.withColumn("week", monday_week("created_at"))
            .groupBy("week")
            .agg(F.count(F.lit(1)).cast("long").alias("signups"),
                 n_if(mature(7)).alias("eligible7"),
                 n_if(mature(7) & act).alias("activated7"),
                 F.sum(F.when(mature(7) & act, fr - ca).otherwise(0)).cast("long").alias("activation_ms"),
                 n_if(mature(14) & act).alias("eligible14"),
                 n_if(mature(14) & act & (F.col("returned_week1") == 1)).alias("retained14"),
                 n_if(mature(35) & act).alias("eligible35"),
                 n_if(mature(35) & act & (F.col("returned_week4") == 1)).alias("retained35"),
                 n_if(mature(30)).alias("eligible30"),
                 n_if(mature(30) & (fp < ca + 30 * DAY)).alias("paid30"))
            .orderBy("week"))


def cohort_totals(cohorts: DataFrame) -> DataFrame:
    """Column sums over all cohorts (zeros when there are none)."""
    return cohorts.agg(*[F.coalesce(F.sum(x), F.lit(0)).cast("long").alias(x) for x in COHORT_COLUMNS])
