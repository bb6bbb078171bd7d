"""Registered ledger queries (phase 3) and their DuckDB oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from meterline.operators import ledger as lg
from meterline.operators import reconcile
from meterline.plans.oracle import with_base
from meterline.plans.registry import register
from meterline.session import checkpoint_dir
from meterline.sources import merge
from meterline.sources.derived import LEDGER_CUTOFF, Model, opening_balances, stored_balances

BAL_CTE = """bal AS (SELECT u.id AS user_id, CAST(COALESCE(s.n_rows, 0) AS BIGINT) AS n_rows,
  CAST(COALESCE(s.balance_micros, 0) AS BIGINT) AS balance_micros
  FROM users u LEFT JOIN (SELECT user_id, COUNT(*) AS n_rows, SUM(amount_micros) AS balance_micros
    FROM ledger GROUP BY user_id) s ON s.user_id = u.id)"""


@register("ledger_balances", with_base("SELECT *, balance_micros < 0 AS negative FROM bal", BAL_CTE))
def q_ledger_balances(spark, sf_dir):
    m = Model(spark, sf_dir)
    return lg.ledger_balances(m.ledger, m.users)


@register("balance_differences", with_base("""SELECT user_id, l AS ledger_micros, b AS stored_micros, coalesce(b, 0) - coalesce(l, 0) AS diff_micros,
  CASE WHEN b IS NULL THEN 'not_stored' WHEN l IS NULL THEN 'no_ledger' ELSE 'amount' END AS kind
FROM (SELECT * FROM sums WHERE l <> 0) FULL JOIN (SELECT user_id, b FROM stored WHERE b <> 0) USING (user_id) WHERE l IS DISTINCT FROM b""",
    "sums AS (SELECT user_id, CAST(sum(amount_micros) AS BIGINT) AS l FROM ledger GROUP BY user_id)",
    """stored AS (SELECT user_id, l + if(user_id % 37 = 0, 1000, 0) AS b FROM sums WHERE user_id % 41 <> 0
  UNION ALL SELECT user_id + 10000000, 5 FROM sums WHERE user_id % 43 = 0)"""))
def q_balance_differences(spark, sf_dir):
    """Ledger against stored balances; the planted faults and nothing else."""
    m = Model(spark, sf_dir)
    return reconcile.balance_differences(m.ledger, stored_balances(m.ev0))


@register("merged_balances", with_base("""SELECT user_id, CAST(o + coalesce(l, 0) AS BIGINT) AS balance_micros
  FROM (SELECT DISTINCT user_id, (user_id % 5) * 4000 AS o FROM ev0) LEFT JOIN (SELECT user_id, sum(amount_micros) AS l FROM ledger GROUP BY user_id) USING (user_id)"""))
def q_merged_balances(spark, sf_dir):
    """Two batches of ledger rows merged into a stored table of balances, then both sent again."""
    m = Model(spark, sf_dir)
    path = f"{checkpoint_dir(spark).rstrip('/')}/balances-{uuid.uuid4().hex}"
    rows = m.ledger.select(F.col("id").alias("event_id"), "user_id", "amount_micros", "created_at")
    late = F.col("created_at") >= LEDGER_CUTOFF
    merge.create(opening_balances(m.ev0), path, 16)
    for batch in (rows.where(~late), rows.where(late), rows):
        merge.merge(spark, path, batch.drop("created_at"), 16)
    return merge.balances(spark, path)


@register("running_balance", with_base("""SELECT id, user_id, created_at, amount_micros,
  CAST(SUM(amount_micros) OVER (PARTITION BY user_id ORDER BY created_at, id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS balance_micros,
  SUM(amount_micros) OVER (PARTITION BY user_id ORDER BY created_at, id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) < 0 AS negative FROM ledger"""))
def q_running_balance(spark, sf_dir):
    return lg.running_balance(Model(spark, sf_dir).ledger)


@register("user_history", with_base("""SELECT user_id, rn, id, kind, amount_micros, created_at FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY id DESC) AS rn FROM ledger) WHERE rn <= 25"""))
def q_user_history(spark, sf_dir):
    return lg.user_history(Model(spark, sf_dir).ledger, 25)


@register("history_amounts", with_base("""SELECT user_id, id, amount_micros,
  concat(CASE WHEN amount_micros > 0 THEN '+' ELSE chr(8722) END, '$',
    CASE WHEN abs(amount_micros) < 10000 THEN printf('%.4f', abs(amount_micros) / 1e6)
      ELSE printf('%.2f', abs(amount_micros) / 1e6) END) AS amount FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY id DESC) AS rn FROM ledger) WHERE rn <= 25"""))
def q_history_amounts(spark, sf_dir):
    rows = lg.user_history(Model(spark, sf_dir).ledger, 25)
    return rows.select("user_id", "id", "amount_micros", lg.history_amount(F.col("amount_micros")).alias("amount"))


def _safe(x: str) -> str:
    d = f"TRY_CAST({x} AS DOUBLE)"
    return (f"CASE WHEN {d} IS NOT NULL AND NOT isnan({d}) AND {d} >= 1 AND {d} <= 9007199254740991.0 "
            f"AND {d} = floor({d}) THEN CAST({d} AS BIGINT) END")


CHECKOUT_CTES = [
    f"""f0 AS (SELECT c.*, {_safe('meta_user_id')} AS uid, {_safe('meta_credit')} AS credit FROM checkout_feed c)""",
    f"""f1 AS (SELECT f0.*, k.session_id IS NOT NULL AS in_ledger, u.id IS NOT NULL AS account FROM f0
  LEFT JOIN (SELECT DISTINCT stripe_session_id AS session_id FROM ledger
    WHERE stripe_session_id IS NOT NULL AND created_at < {LEDGER_CUTOFF}) k ON k.session_id = f0.session_id
  LEFT JOIN users u ON u.id = f0.uid)""",
    """f2 AS (SELECT f1.*, CASE WHEN type NOT IN ('checkout.session.completed', 'checkout.session.async_payment_succeeded') THEN 'ignored'
    WHEN payment_status <> 'paid' THEN 'not_paid' WHEN uid IS NULL OR credit IS NULL THEN 'invalid_metadata'
    WHEN NOT account THEN 'unknown_account' WHEN in_ledger THEN 'replay' ELSE 'eligible' END AS pre FROM f1)""",
    """f3 AS (SELECT f2.*, CASE WHEN pre = 'eligible' THEN ROW_NUMBER() OVER (PARTITION BY session_id, pre = 'eligible'
    ORDER BY arrival, delivery) END AS rn FROM f2)""",
    """fulfil AS (SELECT session_id, delivery, arrival, uid AS user_id,
  CASE WHEN pre <> 'eligible' THEN pre WHEN rn = 1 THEN 'credited' ELSE 'replay' END AS outcome,
  CASE WHEN pre = 'eligible' AND rn = 1 THEN credit END AS credited_micros,
  CASE WHEN pre = 'eligible' AND rn = 1 THEN concat('Added $', printf('%.2f', credit / 1000000.0), ' credit') END AS description
  FROM f3)""",
]


def _fulfil(m: Model):
    existing = m.ledger.where(F.col("created_at") < F.lit(LEDGER_CUTOFF))
    return lg.checkout_fulfilment(m.checkout_feed, existing, m.users)


@register("checkout_fulfilment", with_base("SELECT * FROM fulfil", *CHECKOUT_CTES))
def q_checkout_fulfilment(spark, sf_dir):
    return _fulfil(Model(spark, sf_dir))


@register("balance_upsert", with_base("""SELECT b.user_id, b.balance_micros AS old_balance_micros,
  CAST(b.balance_micros + COALESCE(d.delta, 0) AS BIGINT) AS balance_micros FROM bal b
  LEFT JOIN (SELECT user_id, SUM(credited_micros) AS delta FROM fulfil WHERE outcome = 'credited' GROUP BY user_id) d
  ON d.user_id = b.user_id""", BAL_CTE, *CHECKOUT_CTES))
def q_balance_upsert(spark, sf_dir):
    m = Model(spark, sf_dir)
    return lg.balance_upsert(lg.ledger_balances(m.ledger, m.users), _fulfil(m))
