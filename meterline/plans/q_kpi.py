"""Registered KPI / report queries (V1-V11) and the assembled dashboard."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterline.functions.clock import DAY
from meterline.operators import engagement as eng
from meterline.operators import features as feat
from meterline.operators import kpi, money
from meterline.plans import q_engagement as qe
from meterline.plans import q_money as qm
from meterline.plans.dashboard import activity_daily, dashboard
from meterline.plans.registry import TRACKING_SINCE, register
from meterline.session import materialize
from meterline.sources.catalog import catalog_dict, read_catalog
from meterline.sources.derived import Model, tracking_since


def _num_sql(x: str) -> str:
    r = f"round(CAST({x} AS DOUBLE), 1)"
    return (f"CASE WHEN {r} IS NULL THEN NULL WHEN {r} = floor({r}) THEN format('{{:,}}', CAST({r} AS BIGINT)) "
            f"ELSE format('{{:,.1f}}', {r}) END")


def _ratio_sql(n: str, d: str) -> str:
    return f"CASE WHEN COALESCE({d}, 0) <> 0 THEN {n} / {d} END"


def _change_sql(n: str, p: str, covered: bool = True) -> str:
    if not covered:
        return "'Comparison collecting history'"
    pct = _num_sql(f"abs({n} - {p}) / {p} * 100")
    return (f"CASE WHEN COALESCE({p}, 0) = 0 THEN CASE WHEN COALESCE({n}, 0) <> 0 THEN 'No prior-period baseline' "
            f"ELSE 'No change from prior period' END ELSE concat(CASE WHEN {n} >= {p} THEN '+' ELSE '{kpi.MINUS}' END, "
            f"{pct}, '% vs prior period') END")


WEEKLY_COVERED = TRACKING_SINCE <= qe.C30.end - 14 * DAY
PERIOD_COVERED = TRACKING_SINCE <= qe.C7.previous_start

KPI_SQL = f"""SELECT w.repeat_users AS weekly_repeat_users, w.active AS weekly_active,
  {_change_sql('w.repeat_users', 'w.previous_repeat_users', WEEKLY_COVERED)} AS weekly_change,
  {_ratio_sql('t.activated7', 't.eligible7')} AS activation_rate,
  {_ratio_sql('t.retained14', 't.eligible14')} AS week1_retention,
  {_ratio_sql('t.retained35', 't.eligible35')} AS week4_retention,
  {_ratio_sql('t.paid30', 't.eligible30')} AS paid_conversion,
  t.signups - t.eligible7 AS still_maturing, t.eligible7 - t.activated7 AS missed_first_value,
  {_ratio_sql('t.activation_ms', 't.activated7')} AS mean_time_to_first_value_ms,
  {_ratio_sql('c.runs', 'c.attempts')} AS run_success_rate,
  {_ratio_sql('c.runs', 'c.active')} AS runs_per_active,
  {_ratio_sql('c.active_days', 'c.active')} AS mean_active_days,
  {_ratio_sql('c.repeat_users', 'c.active')} AS repeat_use_rate,
  {_change_sql('c.active', 'p.active', PERIOD_COVERED)} AS active_change,
  {_ratio_sql('w.retained', 'w.previous_active')} AS previous_week_return_rate,
  m.buyers - m.first_buyers AS returning_buyers,
  {_ratio_sql('m.purchased', 'm.purchases')} AS average_purchase,
  {_ratio_sql('m.active_payers', 'c.active')} AS active_payer_share,
  b.credit_blocked_users, d.chart_scale
FROM ({qe.WEEKLY_SQL}) w
CROSS JOIN (SELECT * FROM ({qe.PERIOD_SQL}) WHERE period = 'current') c
CROSS JOIN (SELECT * FROM ({qe.PERIOD_SQL}) WHERE period = 'previous') p
CROSS JOIN ({qm.COHORT_TOTALS_SQL}) t
CROSS JOIN ({qm.MONEY_SQL}) m
CROSS JOIN ({qe.CREDIT_BLOCKED_SQL}) b
CROSS JOIN (SELECT CAST(greatest(1, MAX(runs + failures)) AS BIGINT) AS chart_scale FROM ({qe.DAILY_SQL})) d"""


@register("kpi_rates", KPI_SQL)
def q_kpi_rates(spark, sf_dir):
    # one written rollup of the run events serves all sections whose bounds are whole days, as in the dashboard
    m = Model(spark, sf_dir)
    act = materialize(activity_daily(m, min(qe.C30.start, qe.C7.previous_start), qe.C30.end))
    w = eng.weekly_repeat_users(act, qe.C30)
    per = eng.period_engagement(act, qe.C7)
    c = per.where(F.col("period") == "current").select(*[F.col(x).alias(f"c_{x}") for x in per.columns])
    p = per.where(F.col("period") == "previous").select(*[F.col(x).alias(f"p_{x}") for x in per.columns])
    t = qm.q_cohort_totals(spark, sf_dir)
    m = money.money_summary(m.users, act, m.ledger, m.store_transactions, qm.CM).withColumnRenamed("signups", "money_signups")
    b = eng.credit_blocked_users(act, qe.C30)
    d = eng.daily_series(act, qe.C30, TRACKING_SINCE).agg(
        F.greatest(F.lit(1), F.max(F.col("runs") + F.col("failures"))).cast("long").alias("chart_scale"))
    r, col = kpi.ratio, F.col
    # Every input is one row: these cross joins are 1 x 1.
    j = w.crossJoin(c).crossJoin(p).crossJoin(t).crossJoin(m).crossJoin(b).crossJoin(d)
    return j.select(
        col("repeat_users").alias("weekly_repeat_users"), col("active").alias("weekly_active"),
        kpi.change_text(col("repeat_users"), col("previous_repeat_users"), WEEKLY_COVERED).alias("weekly_change"),
        r(col("activated7"), col("eligible7")).alias("activation_rate"),
        r(col("retained14"), col("eligible14")).alias("week1_retention"),
        r(col("retained35"), col("eligible35")).alias("week4_retention"),
        r(col("paid30"), col("eligible30")).alias("paid_conversion"),
        (col("signups") - col("eligible7")).alias("still_maturing"),
        (col("eligible7") - col("activated7")).alias("missed_first_value"),
        r(col("activation_ms"), col("activated7")).alias("mean_time_to_first_value_ms"),
        r(col("c_runs"), col("c_attempts")).alias("run_success_rate"),
        r(col("c_runs"), col("c_active")).alias("runs_per_active"),
        r(col("c_active_days"), col("c_active")).alias("mean_active_days"),
        r(col("c_repeat_users"), col("c_active")).alias("repeat_use_rate"),
        kpi.change_text(col("c_active"), col("p_active"), PERIOD_COVERED).alias("active_change"),
        r(col("retained"), col("previous_active")).alias("previous_week_return_rate"),
        (col("buyers") - col("first_buyers")).alias("returning_buyers"),
        r(col("purchased"), col("purchases")).alias("average_purchase"),
        r(col("active_payers"), col("c_active")).alias("active_payer_share"),
        "credit_blocked_users", "chart_scale")


# --- V7 / V11 / J16 / X15 feature report ------------------------------------------------
def _catalog_names_sql() -> str:
    rows = ", ".join(f"('{a['slug']}', '{a['name']}', '{a['category']}')" for a in catalog_dict()["automations"])
    labels = ", ".join(f"('{k}', '{v}')" for k, v in kpi.SLUG_LABELS.items())
    return f"cat(slug, name, category) AS (VALUES {rows}), lab(slug, name) AS (VALUES {labels})"


def _duration_sql(ms: str) -> str:
    return (f"CASE WHEN {ms} IS NULL THEN '{kpi.DASH}' WHEN {ms} < 1000 THEN concat({_num_sql(ms)}, ' ms') "
            f"WHEN {ms} < 60000 THEN concat({_num_sql(ms + ' / 1000')}, ' s') "
            f"WHEN {ms} < 3600000 THEN concat({_num_sql(ms + ' / 60000')}, ' min') "
            f"ELSE concat({_num_sql(ms + ' / 3600000')}, ' hr') END")


# Two of the slugs go by one that the catalog lists and one that the labels list; the rest are unknown to both.
SLUGS = {"wf-0": "boil-down", "wf-1": "custom-api"}
_NAMED = "CASE slug " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in SLUGS.items()) + " ELSE slug END"

FEATURE_REPORT_SQL = f"""WITH {_catalog_names_sql()}
SELECT f.slug, COALESCE(c.name, l.name, f.slug, 'Unknown') AS name, COALESCE(c.category, 'API') AS category,
  {_ratio_sql('f.users', 'a.active')} AS reach, {_ratio_sql('f.runs', 'f.attempts')} AS success_rate,
  {_ratio_sql('f.repeat_users', 'f.users')} AS repeat_share, f.attempts - f.runs AS failed,
  {_duration_sql('f.p95_ms')} AS p95_label
FROM (SELECT * REPLACE ({_NAMED} AS slug) FROM ({qe.FEATURE_SQL})) f CROSS JOIN (SELECT * FROM ({qe.period_sql(qe.C30)}) WHERE period = 'current') a
LEFT JOIN cat c ON c.slug = f.slug LEFT JOIN lab l ON l.slug = f.slug"""


@register("feature_report", FEATURE_REPORT_SQL)
def q_feature_report(spark, sf_dir):
    ev = qe._events(spark, sf_dir, qe.C30.previous_start, qe.C30.end)
    f = feat.feature_table(ev, qe.C30).replace(SLUGS, subset=["slug"])
    active = eng.period_engagement(ev, qe.C30).where(F.col("period") == "current").select(F.col("active").alias("_act"))
    j = kpi.with_feature_name(f.crossJoin(active), read_catalog(spark))
    r = kpi.ratio
    return j.select("slug", "name", "category", r(F.col("users"), F.col("_act")).alias("reach"),
                    r(F.col("runs"), F.col("attempts")).alias("success_rate"),
                    r(F.col("repeat_users"), F.col("users")).alias("repeat_share"),
                    (F.col("attempts") - F.col("runs")).alias("failed"),
                    kpi.duration_text(F.col("p95_ms")).alias("p95_label"))


# --- V9 / V11 failure and source reports -------------------------------------------------
_STATUS_VALUES = ", ".join(f"({k}, '{v}')" for k, v in kpi.STATUS_LABELS.items())
_SOURCE_VALUES = ", ".join(f"('{k}', '{v}')" for k, v in kpi.SOURCE_LABELS.items())


@register("failure_report", f"""WITH lab(status, label) AS (VALUES {_STATUS_VALUES})
SELECT f.status, COALESCE(l.label, 'Other failure') AS label, f.attempts, f.users
FROM ({qe.FAILURES_SQL}) f LEFT JOIN lab l ON l.status = f.status""")
def q_failure_report(spark, sf_dir):
    f = qe.q_failures_by_status(spark, sf_dir)
    return kpi.with_status_label(f).select("status", "label", "attempts", "users")


@register("source_report", f"""WITH lab(source, label) AS (VALUES {_SOURCE_VALUES})
SELECT s.source, COALESCE(l.label, s.source) AS label, s.users AS active, s.runs,
  {_ratio_sql('s.runs', 's.attempts')} AS success_rate FROM ({qe.SOURCES_SQL}) s LEFT JOIN lab l ON l.source = s.source""")
def q_source_report(spark, sf_dir):
    s = qe.q_sources(spark, sf_dir)
    return kpi.with_source_label(s).select("source", "label", F.col("users").alias("active"), "runs",
                                           kpi.ratio(F.col("runs"), F.col("attempts")).alias("success_rate"))


# --- V12 / S7 assembled dashboard (golden-tested; rows-only here) ------------------------
@register("today_report", f"""SELECT attempts, runs, attempts - runs AS failures, active, strftime(make_timestamp(last_event * 1000), '%b %-d, %Y') AS last_day,
  strftime(make_timestamp(last_event // 1000 * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS last_second FROM ({qe.TODAY_SQL})""")
def q_today_report(spark, sf_dir):
    """V9 + X14: today's failures beside its attempts, and the labels of the last event's day and second."""
    last = F.timestamp_millis("last_event")
    return qe.q_today(spark, sf_dir).select("attempts", "runs", (F.col("attempts") - F.col("runs")).alias("failures"), "active",
                                            F.date_format(last, "MMM d, yyyy").alias("last_day"),
                                            F.date_format(last, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("last_second"))


def _object_sql(sql: str) -> str:
    return f"(SELECT CAST(to_json(x) AS VARCHAR) FROM ({sql}) x)"


def _list_sql(sql: str, order: str) -> str:
    return f"(SELECT CAST(coalesce(to_json(list(x ORDER BY {order})), '[]') AS VARCHAR) FROM ({sql}) x)"


_C = qe.C30
_START = max(_C.start, TRACKING_SINCE)
_PERIOD = "SELECT attempts, runs, active, repeat_users, active_days FROM ({}) WHERE period = '{}'"
_PARTS = {
    "current": _object_sql(_PERIOD.format(qe.period_sql(_C), "current")), "previous": _object_sql(_PERIOD.format(qe.period_sql(_C), "previous")),
    "weekly": _object_sql(qe.WEEKLY_SQL), "cohorts": _list_sql(qm.cohorts_sql(_C, _START), "week"),
    "totals": _object_sql(qm.totals_sql(_C, _START)), "money": _object_sql(qm.money_sql(_C)),
    "failures": _list_sql(qe.FAILURES_SQL, "attempts DESC, status NULLS LAST"),
    "features": _list_sql(qe.FEATURE_SQL, "users DESC, runs DESC, slug NULLS LAST"), "sources": _list_sql(qe.SOURCES_SQL, "runs DESC, source"),
    "today": _object_sql(qe.TODAY_SQL), "daily": _list_sql(qe.DAILY_SQL, "day")}
_FLAGS = ", ".join(f"'{k}': {str(v).lower()}" for k, v in (
    ("period", TRACKING_SINCE <= _C.start), ("comparison", TRACKING_SINCE <= _C.previous_start), ("weekly", TRACKING_SINCE <= _C.end - 14 * DAY)))
_HEAD = (f"to_json({{'days': 30, 'start': {_C.start}, 'end': {_C.end}, 'trackingSince': {TRACKING_SINCE}, 'updatedAt': {_C.now}, "
         f"'coverage': {{{_FLAGS}}}}})")
DASHBOARD_SQL = f"""SELECT 30 AS days, concat(rtrim(CAST({_HEAD} AS VARCHAR), '}}'), '}}', {", ".join(f"',\"{k}\":', {v}" for k, v in _PARTS.items())}, '}}') AS json"""


@register("dashboard_json", DASHBOARD_SQL)
def q_dashboard_json(spark, sf_dir):
    m = Model(spark, sf_dir)
    return dashboard(m, qe.NOW, 30, tracking_since(m.state, qe.NOW))
