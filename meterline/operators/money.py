"""Money and payer metrics.

"Paid" = a top-up that is either a live card checkout (``stripe_session_id ILIKE
'cs_live_%'``) or the first delivery of a production store purchase
(``apple_event_id = 'purchase:' || id`` for a Production transaction).  Refunds are not
netted; grants are top-ups with neither external id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.functions.clock import Clock, in_range


def paid_ledger(ledger: DataFrame, store_tx: DataFrame) -> DataFrame:
    """F5 + J3: paid top-up rows (user_id, amount_micros, created_at).

    Two disjoint branches instead of ``OR ... IN (subquery)``: the card branch is a plain
    filter; the store branch semi-joins only rows that *have* an ``apple_event_id`` and
    are not already card-paid.  Rows with a NULL key never enter the shuffle, so the
    usage rows (the bulk of the ledger) cannot pile into the NULL-key partition.
    """
    topups = ledger.where(F.col("kind") == "topup")
    card = F.coalesce(F.col("stripe_session_id").ilike("cs_live_%"), F.lit(False))
    keys = (store_tx.where(F.col("environment") == "Production")
            .select(F.concat(F.lit("purchase:"), F.col("id")).alias("apple_event_id")))
    by_card = topups.where(card)
    by_store = (topups.where(~card & F.col("apple_event_id").isNotNull())
                .join(keys, "apple_event_id", "left_semi"))
    cols = ["id", "user_id", "amount_micros", "created_at"]
    return by_card.select(*cols).unionByName(by_store.select(*cols))


def first_purchases(paid: DataFrame) -> DataFrame:
    """A10: user_id -> first paid time."""
    return paid.groupBy("user_id").agg(F.min("created_at").alias("first_paid"))


def money_summary(users: DataFrame, events: DataFrame, ledger: DataFrame, store_tx: DataFrame,
                  c: Clock) -> DataFrame:
    """One row of money metrics."""
    paid = paid_ledger(ledger, store_tx)
    cur = in_range("created_at", c.start, c.end)
    prev = in_range("created_at", c.previous_start, c.start)
    per_buyer = paid.groupBy("user_id").agg(
        F.min("created_at").alias("first_paid"),
        F.sum(F.when(cur, F.col("amount_micros"))).alias("cur_amount"),
        F.sum(F.when(prev, F.col("amount_micros"))).alias("prev_amount"),
        F.count(F.when(cur, 1)).alias("cur_n"))
    buyer_totals = per_buyer.agg(
        F.coalesce(F.sum("cur_amount"), F.lit(0)).cast("long").alias("purchased"),
        F.coalesce(F.sum("prev_amount"), F.lit(0)).cast("long").alias("previous_purchased"),
        F.count(F.when(F.col("cur_n") > 0, 1)).cast("long").alias("buyers"),
        F.count(F.when(in_range("first_paid", c.start, c.end), 1)).cast("long").alias("first_buyers"),
        F.coalesce(F.sum("cur_n"), F.lit(0)).cast("long").alias("purchases"))
    ledger_totals = ledger.where(cur).agg(
        F.coalesce(-F.sum(F.when(F.col("kind") == "usage", F.col("amount_micros"))), F.lit(0))
        .cast("long").alias("consumed"),
        F.coalesce(F.sum(F.when((F.col("kind") == "topup") & F.col("stripe_session_id").isNull()
                                & F.col("apple_event_id").isNull(), F.col("amount_micros"))), F.lit(0))
        .cast("long").alias("granted"))
    signups = users.where(cur).agg(F.count(F.lit(1)).cast("long").alias("signups"))
    payers = active_payers(events, per_buyer.select("user_id", "first_paid"), c)
    # 1-row x 1-row combination of global aggregates (no data-sized cross product).
    return (signups.crossJoin(buyer_totals).crossJoin(ledger_totals).crossJoin(payers)
            .select("signups", "purchased", "previous_purchased", "buyers", "first_buyers",
                    "purchases", "consumed", "granted", "active_payers"))


def active_payers(events: DataFrame, buyers: DataFrame, c: Clock) -> DataFrame:
    """Distinct users with a success in the period who had paid before its end."""
    active = (events.where((F.col("event_name") == "run_succeeded") & F.col("user_id").isNotNull()
                           & in_range("created_at", c.start, c.end))
              .select("user_id").distinct())
    prior = buyers.where(F.col("first_paid") < F.lit(c.end)).select("user_id")
    return active.join(prior, "user_id", "inner").agg(
        F.count(F.lit(1)).cast("long").alias("active_payers"))
