"""V12 + S7: the assembled dashboard document for one reporting clock.

Shared rollup, not shared raw events: the run events of the widest day-aligned window
are aggregated once into ``activity_daily`` -- (day, user, event, slug, source, status)
-> count -- and that rollup (written once) feeds the period, weekly, daily, failure, source,
feature and payer sections.  Every bound of those sections is a whole UTC day, so they
are exact on the rollup (the operators take the count as a row weight).  Only what needs
millisecond precision reads raw rows: the (slug, duration) latency histogram for P95, the
successes of the cohort window (two columns), and the partial current day.  Each section
output is bounded by the report shape (<= 90 days, slugs, statuses, sources, cohort
weeks), which is what ``collect_list`` gathers into the single JSON row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.functions.clock import DAY, clock, day_of
from meterline.operators import cohorts as coh
from meterline.operators import engagement as eng
from meterline.operators import features as feat
from meterline.operators import money
from meterline.session import materialize
from meterline.sources.derived import Model


def _one(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.struct(*df.columns).alias(name))


def _many(df: DataFrame, name: str, order: list) -> DataFrame:
    s = F.struct(*[c if isinstance(c, Column) else F.col(c) for c in order], F.struct(*df.columns).alias("_row"))
    return df.agg(F.transform(F.array_sort(F.collect_list(s)), lambda x: x["_row"]).alias(name))


def activity_daily(m: Model, lo: int, hi: int) -> DataFrame:
    """Run outcomes in ``[lo, hi)`` (day-aligned) rolled up per (day, user, event, slug,
    source, status); ``created_at`` is the day start so day-aligned range filters stay exact."""
    ev = eng.run_outcomes(m.events_between(lo, hi), lo, hi)
    return (ev.groupBy(day_of("created_at").alias("day"), "user_id", "event_name", "slug", "source", "status")
            .agg(F.count(F.lit(1)).alias("n"))
            .select("event_name", "user_id", "slug", "status", "source",
                    (F.col("day") * DAY).alias("created_at"), "n"))


def latency_histogram(m: Model, c) -> DataFrame:
    """(slug, duration_ms) -> count over the period's successes, for the exact P95."""
    ok = eng.successes(m.events_between(c.start, c.end), c.start, c.end).where(F.col("duration_ms").isNotNull())
    return ok.groupBy("slug", "duration_ms").agg(F.count(F.lit(1)).alias("n"))


def dashboard(m: Model, now_ms: int, days, tracking_since: int) -> DataFrame:
    c = clock(now_ms, days)
    lo = min(c.previous_start, c.end - 14 * DAY)
    act = materialize(activity_daily(m, lo, c.end))
    periods = eng.period_engagement(act, c)
    current = periods.where(F.col("period") == "current").drop("period")
    previous = periods.where(F.col("period") == "previous").drop("period")
    cohort_start = max(c.start, tracking_since)
    cohort_ev = (eng.successes(m.events_between(cohort_start, c.end), cohort_start, c.end)
                 .select("event_name", "user_id", "created_at"))
    accounts = coh.account_lifecycle(m.users, cohort_ev, m.ledger, m.store_transactions, c, tracking_since)
    cohorts = materialize(coh.signup_cohorts(accounts, c))  # a few weeks, used twice
    today_ev = m.events_between(c.end, c.now + 1)
    parts = [
        _one(current, "current"), _one(previous, "previous"),
        _one(eng.weekly_repeat_users(act, c), "weekly"),
        _many(cohorts, "cohorts", ["week"]),
        _one(coh.cohort_totals(cohorts), "totals"),
        _one(money.money_summary(m.users, act, m.ledger, m.store_transactions, c), "money"),
        _many(eng.failures_by_status(act, c), "failures", [-F.col("attempts"), F.col("status").isNull(), "status"]),
        _many(feat.feature_table(act, c, latency=latency_histogram(m, c)), "features", [-F.col("users"), -F.col("runs"), F.col("slug").isNull(), "slug"]),
        _many(eng.sources(act, c), "sources", [-F.col("runs"), F.col("source").isNotNull(), "source"]),
        _one(eng.today(today_ev, c), "today"),
        _many(eng.daily_series(act, c, tracking_since), "daily", ["day"]),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # every part is exactly one row
    doc = F.struct(
        F.lit(c.days).alias("days"), F.lit(c.start).alias("start"), F.lit(c.end).alias("end"),
        F.lit(tracking_since).alias("trackingSince"), F.lit(c.now).alias("updatedAt"),
        F.struct(F.lit(tracking_since <= c.start).alias("period"),
                 F.lit(tracking_since <= c.previous_start).alias("comparison"),
                 F.lit(tracking_since <= c.end - 14 * DAY).alias("weekly")).alias("coverage"),
        "current", "previous", "weekly", "cohorts", "totals", "money",
        "failures", "features", "sources", "today", "daily")
    return out.select(F.lit(c.days).alias("days"), F.to_json(doc, {"ignoreNullFields": "false"}).alias("json"))


def export_dashboard(df: DataFrame, path: str) -> None:
    """One JSON document per reporting period, written as text lines."""
    df.select("json").coalesce(1).write.mode("overwrite").text(path)
