"""Registered streaming jobs (phase 7): each runs to completion (availableNow) and the
query returns its sink, compared with the batch oracle of the same computation."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterline.operators import engagement as eng
from meterline.plans import q_engagement as qe
from meterline.plans import q_ledger as ql
from meterline.plans.oracle import with_base
from meterline.plans.registry import register
from meterline.sources.derived import LEDGER_CUTOFF, Model
from meterline.streaming import jobs

DAY = 86_400_000
RUNS = "event_name IN ('run_succeeded', 'run_failed') AND user_id IS NOT NULL"


@register("stream_ingest_events", with_base(f"""SELECT id, event_name, user_id, slug, status, duration_ms, source, created_at,
  created_at // {DAY} AS day FROM analytics_events WHERE {RUNS}"""))
def q_stream_ingest_events(spark, sf_dir):
    path = jobs.ingest_events(spark, sf_dir)
    return spark.read.parquet(path).select(*jobs.ALLOWED_EVENT_COLUMNS, F.col("day").cast("long"))


@register("stream_daily_counts", with_base(f"""SELECT created_at // {DAY} AS day,
  CAST(SUM(CASE WHEN event_name = 'run_succeeded' THEN 1 ELSE 0 END) AS BIGINT) AS runs,
  CAST(SUM(CASE WHEN event_name = 'run_failed' THEN 1 ELSE 0 END) AS BIGINT) AS failures,
  CAST(COUNT(DISTINCT CASE WHEN event_name = 'run_succeeded' THEN user_id END) AS BIGINT) AS active
FROM analytics_events WHERE {RUNS} GROUP BY 1"""))
def q_stream_daily_counts(spark, sf_dir):
    return jobs.daily_counts(spark, sf_dir)


@register("stream_weekly_repeat_users", qe.WEEKLY_SQL)
def q_stream_weekly_repeat_users(spark, sf_dir):
    pairs = spark.read.parquet(jobs.weekly_rollup(spark, sf_dir))
    ev = pairs.select("user_id", "created_at", F.lit("run_succeeded").alias("event_name"))
    return eng.weekly_repeat_users(ev, qe.C30)


@register("stream_checkout_credits", with_base(
    "SELECT session_id, user_id, credited_micros AS credit_micros FROM fulfil WHERE outcome = 'credited'",
    *ql.CHECKOUT_CTES))
def q_stream_checkout_credits(spark, sf_dir):
    m = Model(spark, sf_dir)
    existing = (m.ledger.where((F.col("created_at") < F.lit(LEDGER_CUTOFF)) & F.col("stripe_session_id").isNotNull())
                .select(F.col("stripe_session_id").alias("session_id")))
    return jobs.checkout_stream(spark, sf_dir, m.users, existing)


# --- ST3 / ST5 stateful streaming folds (same oracles as their batch forms) --------------
from meterline.plans import q_purchases as qp  # noqa: E402
from meterline.streaming import stateful  # noqa: E402


@register("stream_rate_limit_flags", qp.RATE_SQL)
def q_stream_rate_limit_flags(spark, sf_dir):
    return stateful.rate_limit_stream(spark, sf_dir, qp.RATE_WINDOW_MS, qp.RATE_MAX)


@register("stream_conditional_debits", qp.DEBITS_SQL)
def q_stream_conditional_debits(spark, sf_dir):
    return stateful.conditional_debit_stream(spark, sf_dir)


# --- ST1 and ST6 with transformWithState ------------------------------------------------
from meterline.operators import purchases as pu  # noqa: E402
from meterline.sources.derived import SESSION7_MS, base_events_from, ledger, prior_transactions, store_feed  # noqa: E402
from meterline.streaming import accounts  # noqa: E402

_PRIOR = "prior AS (SELECT DISTINCT concat(environment, ':', transaction_id) AS t FROM store_feed WHERE seq = 0 AND (id // 8) % 29 = 0)"
# A delivered state that a prior transaction owns already: stale for its owner, refused for others and for a deleted account.
STREAM_STATES_SQL = qp.PURCHASE_STATES_SQL.replace("FROM val WHERE reject_reason IS NULL",
    "FROM val LEFT JOIN prior ON t = concat(environment, ':', transaction_id) WHERE reject_reason IS NULL AND t IS NULL").replace(
    "ev AS (SELECT *, ROW_NUMBER", _PRIOR + ",\nev AS (SELECT *, ROW_NUMBER", 1)
assert STREAM_STATES_SQL.count("prior") == 2


@register("stream_purchase_states", STREAM_STATES_SQL)
def q_stream_purchase_states(spark, sf_dir):
    """ST1 as a stream; transactions delivered before it belong to other accounts or to deleted ones and have no effect."""
    m = Model(spark, sf_dir)
    ev0 = base_events_from(jobs.event_stream(spark, sf_dir))
    rows = pu.stream_validation(store_feed(ev0), m.users)
    moves = ledger(ev0).where("apple_event_id IS NULL").select("user_id", "id", "amount_micros", F.col("created_at").alias("arrival"))
    opening = m.users.select(F.col("id").alias("user_id"), F.lit(0).cast("long").alias("balance_micros"))
    return accounts.purchase_stream(spark, rows, moves, opening, prior_transactions(m.ev0))


@register("stream_session_expiry", with_base(f"""SELECT token_hash, user_id, expires_at FROM (
  SELECT sha256(concat('session-', CAST(event_id AS VARCHAR))) AS token_hash, user_id, created_at + {SESSION7_MS} AS expires_at,
    (SELECT max(created_at) FROM ev0 WHERE event_type = 'view') AS latest FROM ev0 WHERE event_type = 'view') WHERE expires_at < latest"""))
def q_stream_session_expiry(spark, sf_dir):
    """ST6 + F14: sessions of seven days, purged by timers as the stream's time passes their end."""
    ev0 = base_events_from(jobs.event_stream(spark, sf_dir)).where("event_type = 'view'")
    return accounts.expired_sessions(spark, ev0.select(
        F.sha2(F.concat(F.lit("session-"), F.col("event_id").cast("string")), 256).alias("token_hash"), "user_id", "created_at",
        (F.col("created_at") + SESSION7_MS).alias("expires_at")))
