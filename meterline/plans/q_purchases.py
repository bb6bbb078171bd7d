"""Registered purchase-reconciliation and fold queries (phase 4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterline.operators import folds
from meterline.operators import purchases as pu
from meterline.plans.oracle import with_base
from meterline.plans.registry import register
from meterline.sources.derived import Model

RATE_WINDOW_MS = 15 * 60 * 1000
RATE_MAX = 10

_SB = ", ".join(str(x) for x in pu.SANDBOX_USER_IDS)
VAL_BODY = """SELECT id, user_id, transaction_id, seq, environment, revoked, signed_date, arrival,
  CASE WHEN final IS NULL THEN credit END AS credit_micros, final AS reject_reason FROM (
  SELECT v.*, CASE WHEN v.reason IS NULL AND v.user_id <> o.owner THEN 'already_assigned' ELSE v.reason END AS final
  FROM v LEFT JOIN own o ON o.environment = v.environment AND o.transaction_id = v.transaction_id)"""
V_CTE = f"""v AS (SELECT f.*, CASE f.product_id WHEN 'com.example.credits5' THEN 5000000
    WHEN 'com.example.credits10' THEN 10000000 WHEN 'com.example.credits25' THEN 25000000
    WHEN 'com.example.credits50' THEN 50000000 END AS credit,
  CASE WHEN u.id IS NULL THEN 'account_deleted'
    WHEN NOT COALESCE(f.signed_date BETWEEN 1 AND 9007199254740991, false) THEN 'missing_date'
    WHEN f.bundle_id IS DISTINCT FROM 'com.example.credits' OR f.type IS DISTINCT FROM 'Consumable'
      OR f.ownership IS DISTINCT FROM 'PURCHASED' OR f.quantity IS DISTINCT FROM 1 OR f.product_id IS NULL
      OR f.product_id NOT IN ('com.example.credits5', 'com.example.credits10',
        'com.example.credits25', 'com.example.credits50') THEN 'unsupported_purchase'
    WHEN NOT COALESCE(regexp_full_match(f.transaction_id, '\\d{{1,30}}'), false) THEN 'invalid_transaction_id'
    WHEN NOT COALESCE(lower(f.app_account_token) = sha256(CAST(u.id AS VARCHAR)), false) THEN 'different_account'
    WHEN f.environment IS DISTINCT FROM 'Production' AND NOT (f.environment IS NOT DISTINCT FROM 'Sandbox' AND f.user_id IN ({_SB})) THEN 'sandbox_not_allowed'
  END AS reason
  FROM store_feed f LEFT JOIN users u ON u.id = f.user_id)"""
OWN_CTE = """own AS (SELECT environment, transaction_id, user_id AS owner FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY environment, transaction_id ORDER BY arrival, id) AS rn
  FROM v WHERE reason IS NULL) WHERE rn = 1)"""
VALIDATION_SQL = with_base(VAL_BODY, V_CTE, OWN_CTE)


def _validated(m: Model):
    return pu.purchase_validation(m.store_feed, m.users)


@register("purchase_validation", VALIDATION_SQL)
def q_purchase_validation(spark, sf_dir):
    return _validated(Model(spark, sf_dir))


def _states(m: Model):
    ledger_events = (m.ledger.where(F.col("apple_event_id").isNull())
                     .select("user_id", "id", "amount_micros", F.col("created_at").alias("arrival")))
    return folds.purchase_states(pu.accepted_store_events(_validated(m)), ledger_events)


_TX_T = "STRUCT(revoked INTEGER, last_signed BIGINT, revision BIGINT, removed BIGINT, credit BIGINT)"
PURCHASE_STATES_SQL = with_base("""SELECT user_id, event_id, transaction_id, arrival, applied, revision, revoked, delta,
  balance AS balance_after, ledger_kind, apple_event_id FROM fold WHERE seq > 0 AND source = 'store'""",
    V_CTE, OWN_CTE, f"val AS ({VAL_BODY})",
    """ev AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY arrival, source, id) AS seq FROM (
  SELECT user_id, id, concat(environment, ':', transaction_id) AS transaction_id, credit_micros, revoked, signed_date,
    arrival, CAST(NULL AS BIGINT) AS amount_micros, 'store' AS source FROM val WHERE reject_reason IS NULL
  UNION ALL
  SELECT user_id, id, NULL, NULL, NULL, NULL, created_at, amount_micros, 'ledger' FROM ledger WHERE apple_event_id IS NULL))""",
    f"""fold AS (SELECT user_id, CAST(0 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS balance,
    MAP([]::VARCHAR[], []::{_TX_T}[]) AS txs, CAST(NULL AS VARCHAR) AS source, CAST(NULL AS BIGINT) AS event_id,
    CAST(NULL AS VARCHAR) AS transaction_id, CAST(NULL AS BIGINT) AS arrival, CAST(NULL AS BOOLEAN) AS applied,
    CAST(NULL AS BIGINT) AS revision, CAST(NULL AS INTEGER) AS revoked, CAST(NULL AS BIGINT) AS delta,
    CAST(NULL AS VARCHAR) AS ledger_kind, CAST(NULL AS VARCHAR) AS apple_event_id
  FROM (SELECT DISTINCT user_id FROM ev) d
  UNION ALL
  SELECT user_id, seq,
    CASE WHEN source = 'ledger' THEN CASE WHEN amount_micros >= 0 OR balance >= -amount_micros
      THEN balance + amount_micros ELSE balance END ELSE balance + delta END,
    CASE WHEN source = 'ledger' THEN txs ELSE map_concat(txs, MAP([transaction_id], [new_t])) END,
    source, id, transaction_id, arrival, applied, new_t.revision, new_t.revoked, delta,
    CASE WHEN applied THEN CASE WHEN nr = 1 THEN 'refund' ELSE 'topup' END END,
    CASE WHEN applied THEN CASE WHEN new_t.revision = 1 AND nr = 0 THEN concat('purchase:', transaction_id)
      ELSE concat('state:', transaction_id, ':', CAST(new_t.revision AS VARCHAR)) END END
  FROM (SELECT *,
      CASE WHEN applied THEN {{'revoked': nr, 'last_signed': greatest(old.last_signed, signed_date),
          'revision': old.revision + 1, 'removed': removed, 'credit': old.credit}}::{_TX_T}
        ELSE {{'revoked': old.revoked, 'last_signed': greatest(old.last_signed, signed_date),
          'revision': old.revision, 'removed': old.removed, 'credit': old.credit}}::{_TX_T} END AS new_t
    FROM (SELECT *,
        CASE WHEN NOT applied THEN 0 WHEN old.revoked = 2 THEN CASE WHEN nr = 1 THEN 0 ELSE old.credit END
          WHEN nr = 1 THEN -least(old.credit, balance) ELSE old.removed END AS delta,
        CASE WHEN nr = 1 THEN CASE WHEN old.revoked = 2 THEN old.credit ELSE least(old.credit, balance) END
          ELSE 0 END AS removed
      FROM (SELECT *, COALESCE(old.revoked <> nr AND old.last_signed < signed_date, false) AS applied
        FROM (SELECT f.balance, f.txs, e.*, CAST(CASE WHEN e.revoked THEN 1 ELSE 0 END AS INTEGER) AS nr,
            CASE WHEN e.source = 'store' THEN COALESCE(f.txs[e.transaction_id],
              {{'revoked': 2, 'last_signed': 0, 'revision': 0, 'removed': 0, 'credit': e.credit_micros}}::{_TX_T}) END AS old
          FROM fold f JOIN ev e ON e.user_id = f.user_id AND e.seq = f.seq + 1) s1) s2) s3) s4)""", recursive=True)


@register("purchase_states", PURCHASE_STATES_SQL)
def q_purchase_states(spark, sf_dir):
    """ST1: per-event result of the purchase state machine (oracle: DuckDB recursive CTE)."""
    return _states(Model(spark, sf_dir))


STORE_TX_STATES_SQL = PURCHASE_STATES_SQL.replace(
    """SELECT user_id, event_id, transaction_id, arrival, applied, revision, revoked, delta,
  balance AS balance_after, ledger_kind, apple_event_id FROM fold WHERE seq > 0 AND source = 'store'""",
    """SELECT user_id, transaction_id, revision, revoked, net_delta, applied_events FROM (
  SELECT user_id, transaction_id, revision, revoked,
    CAST(SUM(delta) OVER (PARTITION BY user_id, transaction_id) AS BIGINT) AS net_delta,
    CAST(COUNT(CASE WHEN applied THEN 1 END) OVER (PARTITION BY user_id, transaction_id) AS BIGINT) AS applied_events,
    ROW_NUMBER() OVER (PARTITION BY user_id, transaction_id ORDER BY arrival DESC, event_id DESC) AS rn
  FROM fold WHERE seq > 0 AND source = 'store') WHERE rn = 1""")
assert STORE_TX_STATES_SQL != PURCHASE_STATES_SQL


@register("store_transaction_states", STORE_TX_STATES_SQL)
def q_store_transaction_states(spark, sf_dir):
    """Final state per transaction: the last event's revision/revoked/delta (max_by arrival)."""
    s = _states(Model(spark, sf_dir))
    return (s.groupBy("user_id", "transaction_id")
            .agg(F.max_by(F.struct("revision", "revoked", "balance_after"), F.struct("arrival", "event_id"))
                 .alias("last"),
                 F.sum("delta").alias("net_delta"),
                 F.count(F.when(F.col("applied"), 1)).alias("applied_events"))
            .select("user_id", "transaction_id", "last.revision", "last.revoked", "net_delta", "applied_events"))


DEBITS_SQL = with_base("""SELECT id, user_id, accepted, balance AS balance_after FROM fold WHERE seq > 0""",
    """ev AS (SELECT id, user_id, amount_micros,
  ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY created_at, id) AS seq FROM ledger)""",
    """fold AS (SELECT user_id, CAST(0 AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BOOLEAN) AS accepted,
    CAST(0 AS BIGINT) AS balance FROM (SELECT DISTINCT user_id FROM ev) d
  UNION ALL
  SELECT e.user_id, e.seq, e.id, (e.amount_micros >= 0 OR f.balance >= -e.amount_micros),
    CASE WHEN e.amount_micros >= 0 OR f.balance >= -e.amount_micros THEN f.balance + e.amount_micros ELSE f.balance END
  FROM fold f JOIN ev e ON e.user_id = f.user_id AND e.seq = f.seq + 1)""", recursive=True)


@register("conditional_debits", DEBITS_SQL)
def q_conditional_debits(spark, sf_dir):
    return folds.conditional_debits(Model(spark, sf_dir).ledger)


RATE_SQL = with_base(f"""SELECT key, id, ts, reset - {RATE_WINDOW_MS} AS window_start, n, n <= {RATE_MAX} AS allowed
FROM rl WHERE seq > 0""",
    """h AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id AS id, created_at AS ts,
  ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY created_at, event_id) AS seq FROM ev0)""",
    f"""rl AS (SELECT key, CAST(0 AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS ts,
    CAST(NULL AS BIGINT) AS reset, CAST(0 AS BIGINT) AS n FROM (SELECT DISTINCT key FROM h) d
  UNION ALL
  SELECT h.key, h.seq, h.id, h.ts,
    CASE WHEN r.reset IS NULL OR r.reset < h.ts THEN h.ts + {RATE_WINDOW_MS} ELSE r.reset END,
    CASE WHEN r.reset IS NULL OR r.reset < h.ts THEN 1 ELSE r.n + 1 END
  FROM rl r JOIN h ON h.key = r.key AND h.seq = r.seq + 1)""", recursive=True)


@register("rate_limit_flags", RATE_SQL)
def q_rate_limit_flags(spark, sf_dir):
    """ST5 with the signup limiter's parameters (10 per 15 minutes), one key per account."""
    ev0 = Model(spark, sf_dir).ev0
    hits = ev0.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("id"),
                      F.col("created_at").alias("ts"))
    return folds.rate_limit_flags(hits, RATE_WINDOW_MS, RATE_MAX)


# --- O5 column back-fill ------------------------------------------------------------------
# Transactions of purchases: revoked where the id is divisible by 3; every other revoked one has a refund row of half its credit (odd ids).
BACKFILL_SQL = with_base("""SELECT t.id, t.revoked, t.credit_micros,
  CAST(CASE WHEN t.revoked = 1 THEN coalesce(-r.amount_micros, t.credit_micros) ELSE 0 END AS BIGINT) AS removed_micros
FROM tx t LEFT JOIN refunds r ON r.apple_event_id = concat('refund:', t.id)""",
    """tx AS (SELECT id, event_id, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS revoked, credit_micros FROM (
  SELECT concat(CASE WHEN k % 5 = 3 THEN 'Production:' ELSE 'Sandbox:' END, CAST(event_id AS VARCHAR)) AS id, event_id,
    CAST(floor(value * 1000000) AS BIGINT) AS credit_micros FROM ev0 WHERE event_type = 'purchase' AND k % 5 >= 3))""",
    """refunds AS (SELECT concat('refund:', id) AS apple_event_id, -(credit_micros // 2) AS amount_micros FROM tx
  WHERE revoked = 1 AND event_id % 2 = 1)""")


@register("refund_backfill", BACKFILL_SQL)
def q_refund_backfill(spark, sf_dir):
    ev0 = Model(spark, sf_dir).ev0
    env = F.when(F.col("k") % 5 == 3, "Production:").otherwise("Sandbox:")
    tx = (ev0.where((F.col("event_type") == "purchase") & (F.col("k") % 5 >= 3))
          .select(F.concat(env, F.col("event_id").cast("string")).alias("id"), "event_id", (F.col("event_id") % 3 == 0).cast("int").alias("revoked"),
                  F.floor(F.col("value") * 1_000_000).cast("long").alias("credit_micros"), F.lit(0).cast("long").alias("removed_micros")))
    refunds = tx.where("revoked = 1 AND event_id % 2 = 1").select(
        F.concat(F.lit("refund:"), F.col("id")).alias("apple_event_id"), (-F.floor(F.col("credit_micros") / 2)).cast("long").alias("amount_micros"))
    return pu.refund_backfill(tx, refunds).select("id", "revoked", "credit_micros", "removed_micros")


# --- F18 / J13 store notifications ------------------------------------------------------
# Fixed rule: each delivered state is also sent as a notification; variant 6 arrives as an
# unhandled type, ids divisible by 97 are TEST pings, ids divisible by 89 lack a payload.
_NOTIF_TYPE_SQL = """CASE WHEN id % 97 = 0 THEN 'TEST' WHEN seq IN (0, 1) THEN 'ONE_TIME_CHARGE'
  WHEN seq IN (2, 5) THEN 'REFUND' WHEN seq = 3 THEN 'REFUND_REVERSED' WHEN seq = 4 THEN 'REVOKE'
  ELSE 'CONSUMPTION_REQUEST' END"""


def _notifications(m: Model):
    seq = F.col("seq")
    t = (F.when(F.col("id") % 97 == 0, "TEST").when(seq.isin(0, 1), "ONE_TIME_CHARGE").when(seq.isin(2, 5), "REFUND")
         .when(seq == 3, "REFUND_REVERSED").when(seq == 4, "REVOKE").otherwise("CONSUMPTION_REQUEST"))
    return m.store_feed.select("id", t.alias("notification_type"),
                               F.when(F.col("id") % 89 != 0, F.concat(F.lit("jws."), F.col("transaction_id")))
                               .alias("signed_transaction_info"), "app_account_token", "environment")


@register("notification_routing", with_base(f"""SELECT n.id, n.notification_type, u.id AS routed_user_id, n.environment
FROM (SELECT id, {_NOTIF_TYPE_SQL} AS notification_type,
    CASE WHEN id % 89 <> 0 THEN concat('jws.', transaction_id) END AS signed_transaction_info,
    app_account_token, environment FROM store_feed) n
JOIN users u ON lower(n.app_account_token) = sha256(CAST(u.id AS VARCHAR))
WHERE n.notification_type IN ('ONE_TIME_CHARGE', 'REFUND', 'REVOKE', 'REFUND_REVERSED')
  AND n.signed_transaction_info IS NOT NULL AND (n.environment <> 'Sandbox' OR u.id IN ({_SB}))"""))
def q_notification_routing(spark, sf_dir):
    m = Model(spark, sf_dir)
    return pu.route_notifications(_notifications(m), m.users) \
        .select("id", "notification_type", "routed_user_id", "environment")
