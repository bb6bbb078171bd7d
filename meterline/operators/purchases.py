"""Store purchase validation and routing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.operators.folds import store_product_credit
from meterline.operators.ledger import MAX_SAFE_INTEGER
from meterline.sources import dims as D
from meterline.sources.derived import account_token

# Fixed configuration: accounts allowed to redeem sandbox purchases (a short config list,
# applied as a literal IN-list, never as a data-sized broadcast).
SANDBOX_USER_IDS = (4, 8, 12, 16, 20)
# The store notification types that carry a transaction to apply.
NOTIFICATION_TYPES = ("ONE_TIME_CHARGE", "REFUND", "REVOKE", "REFUND_REVERSED")


def _with_reason(feed: DataFrame, users: DataFrame, sandbox_ids) -> DataFrame:
    """``feed`` with ``_reason``: the first rule that a delivered state breaks by itself."""
    accounts = users.select(F.col("id").alias("user_id"), account_token(F.col("id")).alias("user_token"))
    j = feed.join(accounts, "user_id", "left")
    credit = store_product_credit("product_id")

    def differs(name, value):  # a missing field is a different one
        return ~F.col(name).eqNullSafe(F.lit(value))

    signed = F.coalesce(F.col("signed_date").between(1, MAX_SAFE_INTEGER), F.lit(False))
    reason = (F.when(F.col("user_token").isNull(), "account_deleted")
              .when(~signed, "missing_date")
              .when(differs("bundle_id", D.BUNDLE_ID) | differs("type", "Consumable")
                    | differs("ownership", "PURCHASED") | differs("quantity", 1) | credit.isNull(),
                    "unsupported_purchase")
              .when(~F.coalesce(F.col("transaction_id").rlike(r"^\d{1,30}\z"), F.lit(False)), "invalid_transaction_id")
              .when(~F.coalesce(F.lower(F.col("app_account_token")) == F.col("user_token"), F.lit(False)),
                    "different_account")
              .when(differs("environment", "Production")
                    & (differs("environment", "Sandbox") | ~F.col("user_id").isin(*sandbox_ids)),
                    "sandbox_not_allowed"))
    return j.withColumn("_reason", reason)


def purchase_validation(feed: DataFrame, users: DataFrame,
                        sandbox_ids=SANDBOX_USER_IDS) -> DataFrame:
    """F17 + J9: first failing rule per delivered transaction state, NULL when accepted.

    Rules in order: account must exist; a positive safe-integer signing date; bundle, consumable type, purchased ownership,
    quantity 1 and a listed product; numeric id of 1-30 digits; the transaction's account
    token (case-insensitive) equals the account's; production, or sandbox for an
    allow-listed account; and (J12) no other account redeemed the transaction first.
    """
    v = _with_reason(feed, users, sandbox_ids)
    # A transaction belongs to the first account that redeemed it (by arrival); the
    # same transaction presented by another account is refused.  Owner per transaction
    # is an aggregate (skew-safe), joined back on the transaction key.
    owners = (v.where(F.col("_reason").isNull()).groupBy("environment", "transaction_id")
              .agg(F.min_by("user_id", F.struct("arrival", "id")).alias("_owner")))
    v = v.join(owners, ["environment", "transaction_id"], "left")
    credit = store_product_credit("product_id")
    final = F.when(F.col("_reason").isNull() & (F.col("user_id") != F.col("_owner")), F.lit("already_assigned")) \
        .otherwise(F.col("_reason"))
    return v.select("id", "user_id", "transaction_id", "seq", "environment", "revoked", "signed_date",
                    "arrival", F.when(final.isNull(), credit).alias("credit_micros"),
                    final.alias("reject_reason"))


def stream_validation(feed: DataFrame, users: DataFrame, sandbox_ids=SANDBOX_USER_IDS) -> DataFrame:
    """F17 + J9 over a stream: the states that break no rule by themselves, keyed as ``environment:transactionId``.

    Which account owns a transaction depends on earlier rows; the stream's state decides that.
    """
    return _with_reason(feed, users, sandbox_ids).where("_reason IS NULL").select(
        "user_id", "id", F.concat("environment", F.lit(":"), "transaction_id").alias("transaction_id"),
        store_product_credit("product_id").alias("credit_micros"), "revoked", "signed_date", "arrival")


def accepted_store_events(validated: DataFrame) -> DataFrame:
    """Accepted states keyed as ``environment:transactionId`` for the state machine."""
    return (validated.where(F.col("reject_reason").isNull())
            .select("user_id", "id", F.concat("environment", F.lit(":"), "transaction_id").alias("transaction_id"),
                    "credit_micros", "revoked", "signed_date", "arrival"))


def route_notifications(notifications: DataFrame, users: DataFrame,
                        sandbox_ids=SANDBOX_USER_IDS) -> DataFrame:
    """F18 + J13: keep the four handled notification types with a payload, route each to
    the account whose token matches (case-insensitive); unknown accounts and sandbox
    events for accounts not allow-listed are acknowledged and dropped."""
    n = notifications.where(F.col("notification_type").isin(*NOTIFICATION_TYPES)
                            & F.col("signed_transaction_info").isNotNull())
    accounts = users.select(F.col("id").alias("routed_user_id"), account_token(F.col("id")).alias("token"))
    r = n.join(accounts, F.lower(n["app_account_token"]) == accounts["token"], "inner")
    return r.where((F.col("environment") != "Sandbox") | F.col("routed_user_id").isin(*sandbox_ids)) \
        .drop("token")


def refund_backfill(transactions: DataFrame, ledger: DataFrame) -> DataFrame:
    """For revoked transactions, removed = -amount of the ``refund:<id>`` ledger row,
    else the transaction's full credit; other rows keep their value."""
    refunds = (ledger.where(F.col("apple_event_id").startswith("refund:"))
               .groupBy("apple_event_id").agg(F.first("amount_micros").alias("refund_amount")))
    t = transactions.join(refunds, F.concat(F.lit("refund:"), transactions["id"]) == refunds["apple_event_id"],
                          "left")
    removed = (F.when(transactions["revoked"] == 1,
                      F.coalesce(-F.col("refund_amount"), transactions["credit_micros"]))
               .otherwise(transactions["removed_micros"]))
    return t.select(*[transactions[c] for c in transactions.columns if c != "removed_micros"],
                    removed.alias("removed_micros"))
