"""Registered lifecycle, cohort and money queries (phase 2) and their DuckDB oracles."""

from __future__ import annotations

from meterline.functions.clock import DAY, clock
from meterline.operators import cohorts as coh
from meterline.operators import money
from meterline.plans.oracle import with_base
from meterline.plans.registry import COHORT_NOW, NOW, TRACKING_SINCE, register
from meterline.sources.derived import Model

CC = clock(COHORT_NOW, 90)
CM = clock(NOW, 7)
COHORT_START = max(CC.start, TRACKING_SINCE)

# Ledger rows with what they are: a payment is a top-up by live card checkout or a store purchase known as a production
# transaction; a grant is a top-up that names neither; the rest are uses or unpaid.
FACTS_CTE = """facts AS (SELECT g.user_id AS u, g.created_at AS t, g.amount_micros AS m, CASE
    WHEN g.kind = 'usage' THEN 'use'
    WHEN g.kind = 'topup' AND (g.stripe_session_id ILIKE 'cs_live_%' OR p.id IS NOT NULL) THEN 'paid'
    WHEN g.kind = 'topup' AND coalesce(g.stripe_session_id, g.apple_event_id) IS NULL THEN 'grant' END AS what
  FROM ledger g LEFT JOIN (SELECT DISTINCT id FROM app_store_transactions WHERE environment = 'Production') p
    ON concat('purchase:', p.id) = g.apple_event_id)"""
PAYERS_CTE = "payers AS (SELECT u, min(t) AS since FROM facts WHERE what = 'paid' GROUP BY u)"



def lifecycle_ctes(c, cohort_start: int) -> tuple[str, ...]:
    """Accounts that signed up in ``[cohort_start, c.end)`` with the ages (time since signup) of their successes, and their weekly cohorts.

    ``old`` is the whole days from signup to the end of the period, ``quick`` a first success within a week.
    """
    accounts = f"""accounts AS (SELECT s.id, s.created_at, s.created_at + list_min(ages) AS first_run,
  CASE WHEN ages IS NOT NULL THEN CAST(len(list_filter(ages, lambda a: a // {DAY} BETWEEN 7 AND 13)) > 0 AS INTEGER) END AS returned_week1,
  CASE WHEN ages IS NOT NULL THEN CAST(len(list_filter(ages, lambda a: a // {DAY} BETWEEN 28 AND 34)) > 0 AS INTEGER) END AS returned_week4,
  since AS first_paid
FROM (SELECT id, created_at FROM users WHERE created_at BETWEEN {cohort_start} AND {c.end - 1}) s LEFT JOIN payers ON payers.u = s.id
LEFT JOIN (SELECT x.id, list(e.created_at - x.created_at) AS ages FROM users x JOIN analytics_events e ON e.user_id = x.id
  WHERE e.event_name = 'run_succeeded' AND e.created_at BETWEEN x.created_at AND {c.end - 1} GROUP BY x.id) r ON r.id = s.id)"""
    cohorts = f"""cohorts AS (SELECT strftime(DATE '1970-01-05' + CAST(7 * ((created_at // {DAY} - 4) // 7) AS INTEGER), '%Y-%m-%d') AS week,
  count(*) AS signups, count(*) FILTER (old >= 7) AS eligible7, count(*) FILTER (old >= 7 AND quick) AS activated7,
  CAST(coalesce(sum(first_run - created_at) FILTER (old >= 7 AND quick), 0) AS BIGINT) AS activation_ms,
  count(*) FILTER (old >= 14 AND quick) AS eligible14, count(*) FILTER (old >= 14 AND quick AND returned_week1 > 0) AS retained14,
  count(*) FILTER (old >= 35 AND quick) AS eligible35, count(*) FILTER (old >= 35 AND quick AND returned_week4 > 0) AS retained35,
  count(*) FILTER (old >= 30) AS eligible30, count(*) FILTER (old >= 30 AND (first_paid - created_at) // {DAY} < 30) AS paid30
FROM (SELECT *, ({c.end} - created_at) // {DAY} AS old, coalesce((first_run - created_at) // {DAY} < 7, false) AS quick FROM accounts) GROUP BY 1)"""
    return FACTS_CTE, PAYERS_CTE, accounts, cohorts


_TOT = ", ".join(f"CAST(COALESCE(SUM({x}), 0) AS BIGINT) AS {x}" for x in coh.COHORT_COLUMNS)


def cohorts_sql(c, cohort_start: int) -> str:
    return with_base("SELECT * FROM cohorts ORDER BY week", *lifecycle_ctes(c, cohort_start))


def totals_sql(c, cohort_start: int) -> str:
    return with_base(f"SELECT {_TOT} FROM cohorts", *lifecycle_ctes(c, cohort_start))


def _lifecycle(spark, sf_dir):
    m = Model(spark, sf_dir)
    return coh.account_lifecycle(m.users, m.events_between(COHORT_START, CC.end), m.ledger,
                                 m.store_transactions, CC, TRACKING_SINCE)


@register("account_lifecycle", with_base("SELECT * FROM accounts", *lifecycle_ctes(CC, COHORT_START)))
def q_account_lifecycle(spark, sf_dir):
    return _lifecycle(spark, sf_dir)


@register("signup_cohorts", cohorts_sql(CC, COHORT_START))
def q_signup_cohorts(spark, sf_dir):
    return coh.signup_cohorts(_lifecycle(spark, sf_dir), CC)


COHORT_TOTALS_SQL = totals_sql(CC, COHORT_START)


@register("cohort_totals", COHORT_TOTALS_SQL)
def q_cohort_totals(spark, sf_dir):
    return coh.cohort_totals(coh.signup_cohorts(_lifecycle(spark, sf_dir), CC))


# --- money ------------------------------------------------------------------------------
def runners_cte(c) -> str:
    return f"""runners AS (SELECT DISTINCT user_id AS u FROM analytics_events
  WHERE event_name = 'run_succeeded' AND created_at BETWEEN {c.start} AND {c.end - 1})"""


def paying_sql(c) -> str:
    return f"(SELECT count(*) FROM runners JOIN payers USING (u) WHERE since < {c.end}) AS active_payers"


def _moved(what: str, back: int = 0, sign: str = "") -> str:
    return f"CAST(coalesce({sign}sum(m) FILTER (what = '{what}' AND back = {back}), 0) AS BIGINT)"


def money_sql(c) -> str:
    """From what each user moved in the period (``back`` 0) and the one before it (1)."""
    moved = f"""moved AS (SELECT u, what, ({c.end} - 1 - t) // {c.end - c.start} AS back, sum(m) AS m, count(*) AS n
  FROM facts WHERE t BETWEEN {c.previous_start} AND {c.end - 1} GROUP BY ALL)"""
    return with_base(f"""SELECT (SELECT count(*) FROM users WHERE created_at BETWEEN {c.start} AND {c.end - 1}) AS signups,
  {_moved('paid')} AS purchased, {_moved('paid', 1)} AS previous_purchased, count(*) FILTER (what = 'paid' AND back = 0) AS buyers,
  (SELECT count(*) FROM payers WHERE since BETWEEN {c.start} AND {c.end - 1}) AS first_buyers,
  CAST(coalesce(sum(n) FILTER (what = 'paid' AND back = 0), 0) AS BIGINT) AS purchases,
  {_moved('use', 0, '-')} AS consumed, {_moved('grant')} AS granted, {paying_sql(c)}
FROM moved""", FACTS_CTE, PAYERS_CTE, moved, runners_cte(c))


MONEY_SQL = money_sql(CM)


@register("money_summary", MONEY_SQL)
def q_money_summary(spark, sf_dir):
    m = Model(spark, sf_dir)
    return money.money_summary(m.users, m.events_between(CM.start, CM.end), m.ledger,
                               m.store_transactions, CM)


@register("first_purchases", with_base("SELECT u AS user_id, since AS first_paid FROM payers", FACTS_CTE, PAYERS_CTE))
def q_first_purchases(spark, sf_dir):
    m = Model(spark, sf_dir)
    return money.first_purchases(money.paid_ledger(m.ledger, m.store_transactions))


@register("active_payers", with_base(f"SELECT {paying_sql(CM)}", FACTS_CTE, PAYERS_CTE, runners_cte(CM)))
def q_active_payers(spark, sf_dir):
    m = Model(spark, sf_dir)
    buyers = money.first_purchases(money.paid_ledger(m.ledger, m.store_transactions))
    return money.active_payers(m.events_between(CM.start, CM.end), buyers, CM)
