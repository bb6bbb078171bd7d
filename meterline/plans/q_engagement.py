"""Registered engagement queries (phase 0/1) and their DuckDB oracles."""

from __future__ import annotations

from meterline.functions.clock import DAY, clock
from meterline.operators import engagement as eng
from meterline.operators import features as feat
from meterline.plans.oracle import with_base
from meterline.plans.registry import NOW, TRACKING_SINCE, register
from meterline.sources.derived import Model

C30 = clock(NOW, 30)
C7 = clock(NOW, 7)

# The oracles count from daily cells: one row per day, user, automation, source, status and outcome.
CELLS = f"""cells AS (SELECT created_at // {DAY} AS d, user_id AS u, slug AS f, source AS via, status AS st,
  event_name = 'run_succeeded' AS good, count(*) AS c FROM analytics_events
  WHERE starts_with(event_name, 'run_') AND user_id IS NOT NULL GROUP BY ALL)"""


def _days(c) -> str:
    return f"d BETWEEN {c.start_day} AND {c.end_day - 1}"


def _events(spark, sf_dir, lo, hi):
    return Model(spark, sf_dir).events_between(lo, hi)


# --- A2 weekly repeat users (minimum slice / flagship) ---------------------------------
WEEKLY_SQL = with_base("""SELECT count(*) FILTER (d0 > 0) AS active, count(*) FILTER (d0 > 1) AS repeat_users,
  count(*) FILTER (d1 > 1) AS previous_repeat_users, count(*) FILTER (d1 > 0) AS previous_active,
  count(*) FILTER (least(d0, d1) > 0) AS retained, count(*) FILTER (d1 > 0 AND d0 = 0) AS lapsed
FROM weeks""", CELLS, f"""weeks AS (SELECT u, len(list_filter(ds, lambda d: d >= {C30.end_day - 7})) AS d0,
  len(list_filter(ds, lambda d: d < {C30.end_day - 7})) AS d1
  FROM (SELECT u, list(DISTINCT d) AS ds FROM cells WHERE good AND d BETWEEN {C30.end_day - 14} AND {C30.end_day - 1} GROUP BY u))""")


@register("weekly_repeat_users", WEEKLY_SQL)
def q_weekly_repeat_users(spark, sf_dir):
    return eng.weekly_repeat_users(_events(spark, sf_dir, C30.end - 14 * DAY, C30.end), C30)


# --- A1 period engagement ---------------------------------------------------------------
def period_sql(c) -> str:
    return with_base("""SELECT period, CAST(coalesce(sum(tries), 0) AS BIGINT) AS attempts, CAST(coalesce(sum(good_runs), 0) AS BIGINT) AS runs,
  count(*) FILTER (good_runs > 0) AS active, count(*) FILTER (days > 1) AS repeat_users, CAST(coalesce(sum(days), 0) AS BIGINT) AS active_days
FROM (VALUES ('current', 0), ('previous', 1)) v(period, back) LEFT JOIN people USING (back) GROUP BY period""", CELLS,
        f"""people AS (SELECT ({c.end_day} - 1 - d) // {c.days} AS back, u, sum(c) AS tries, sum(c) FILTER (good) AS good_runs,
  count(DISTINCT d) FILTER (good) AS days FROM cells WHERE d BETWEEN {c.previous_start_day} AND {c.end_day - 1} GROUP BY ALL)""")


PERIOD_SQL = period_sql(C7)


@register("period_engagement", PERIOD_SQL)
def q_period_engagement(spark, sf_dir):
    return eng.period_engagement(_events(spark, sf_dir, C7.previous_start, C7.end), C7)


# --- A3 + J21 daily series --------------------------------------------------------------
DAILY_SQL = with_base(f"""SELECT g.d AS day, g.d * {DAY} AS time, g.d * {DAY} >= {TRACKING_SINCE} AS covered,
  CAST(coalesce(sum(c) FILTER (good), 0) AS BIGINT) AS runs, CAST(coalesce(sum(c) FILTER (NOT good), 0) AS BIGINT) AS failures,
  count(DISTINCT u) FILTER (good) AS active
FROM (SELECT unnest(generate_series({C30.start_day}, {C30.end_day - 1})) AS d) g LEFT JOIN cells USING (d) GROUP BY g.d ORDER BY g.d""", CELLS)


@register("daily_series", DAILY_SQL)
def q_daily_series(spark, sf_dir):
    return eng.daily_series(_events(spark, sf_dir, C30.start, C30.end), C30, TRACKING_SINCE)


# --- A4 feature table (+J4, J5, W1-W3) --------------------------------------------------
# the value at place ceil(0.95 n) of the sorted durations of successes
P95_LIST = f"""slow AS (SELECT slug AS f, list(duration_ms ORDER BY duration_ms) AS ms FROM analytics_events
  WHERE event_name = 'run_succeeded' AND user_id IS NOT NULL AND duration_ms IS NOT NULL
    AND created_at // {DAY} BETWEEN {C30.start_day} AND {C30.end_day - 1} GROUP BY slug)"""
FEATURE_SQL = with_base("""SELECT t.f AS slug, attempts, runs, users, credit_blocks,
  CASE WHEN t.f IS NULL THEN 0 ELSE repeat_users END AS repeat_users, s.ms[(95 * len(s.ms) + 99) // 100] AS p95_ms
FROM totals t LEFT JOIN slow s ON s.f = t.f ORDER BY users DESC, runs DESC, slug""", CELLS,
    f"""people AS (SELECT f, u, sum(c) AS tries, coalesce(sum(c) FILTER (good), 0) AS good_runs, count(DISTINCT d) FILTER (good) AS days,
  sum(c) FILTER (st = 402) AS blocked, count(st) AS known FROM cells WHERE {_days(C30)} GROUP BY f, u)""",
    """totals AS (SELECT f, CAST(sum(tries) AS BIGINT) AS attempts, CAST(sum(good_runs) AS BIGINT) AS runs, count(*) FILTER (good_runs > 0) AS users,
  CASE WHEN sum(known) > 0 THEN CAST(coalesce(sum(blocked), 0) AS BIGINT) END AS credit_blocks,
  count(*) FILTER (days > 1) AS repeat_users FROM people GROUP BY f)""", P95_LIST)


@register("feature_table", FEATURE_SQL)
def q_feature_table(spark, sf_dir):
    return feat.feature_table(_events(spark, sf_dir, C30.start, C30.end), C30)


FEATURE_P95_SQL = with_base("SELECT f AS slug, len(ms) AS n, ms[(95 * len(ms) + 99) // 100] AS p95_ms FROM slow", P95_LIST)


@register("feature_p95", FEATURE_P95_SQL)
def q_feature_p95(spark, sf_dir):
    return feat.feature_p95(_events(spark, sf_dir, C30.start, C30.end), C30)


# --- A11 / A14 failures -----------------------------------------------------------------
FAILURES_SQL = with_base(f"""SELECT st AS status, CAST(sum(c) AS BIGINT) AS attempts, count(DISTINCT u) AS users
FROM cells WHERE NOT good AND {_days(C30)} GROUP BY st ORDER BY attempts DESC, status""", CELLS)


@register("failures_by_status", FAILURES_SQL)
def q_failures_by_status(spark, sf_dir):
    return eng.failures_by_status(_events(spark, sf_dir, C30.start, C30.end), C30)


CREDIT_BLOCKED_SQL = with_base(
    f"SELECT count(DISTINCT u) AS credit_blocked_users FROM cells WHERE NOT good AND st = 402 AND {_days(C30)}", CELLS)


@register("credit_blocked_users", CREDIT_BLOCKED_SQL)
def q_credit_blocked_users(spark, sf_dir):
    return eng.credit_blocked_users(_events(spark, sf_dir, C30.start, C30.end), C30)


# --- A12 sources ------------------------------------------------------------------------
SOURCES_SQL = with_base(f"""SELECT source, CAST(sum(tries) AS BIGINT) AS attempts, CAST(sum(good_runs) AS BIGINT) AS runs,
  count(*) FILTER (good_runs > 0) AS users
FROM (SELECT ifnull(via, 'unknown') AS source, u, sum(c) AS tries, sum(if(good, c, 0)) AS good_runs FROM cells WHERE {_days(C30)} GROUP BY ALL)
GROUP BY source ORDER BY runs DESC, source""", CELLS)


@register("sources", SOURCES_SQL)
def q_sources(spark, sf_dir):
    return eng.sources(_events(spark, sf_dir, C30.start, C30.end), C30)


# --- A13 today --------------------------------------------------------------------------
TODAY_SQL = with_base(f"""SELECT coalesce(CAST(sum(tries) AS BIGINT), 0) AS attempts, coalesce(CAST(sum(good_runs) AS BIGINT), 0) AS runs,
  count(*) FILTER (good_runs > 0) AS active, max(latest) AS last_event
FROM (SELECT user_id, count(*) AS tries, count(*) FILTER (event_name = 'run_succeeded') AS good_runs, max(created_at) AS latest
  FROM analytics_events WHERE starts_with(event_name, 'run_') AND user_id IS NOT NULL
    AND created_at BETWEEN {C30.end} AND {C30.now} GROUP BY user_id)""")


@register("today", TODAY_SQL)
def q_today(spark, sf_dir):
    return eng.today(_events(spark, sf_dir, C30.end, C30.now + 1), C30)
