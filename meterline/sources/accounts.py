"""Account-side service tables derived from the driver tables (Spark side).

Same rules as the DuckDB CTEs in ``meterline.plans.oracle.ACCOUNT_CTES``.  Fixed rules:

* accounts: every derived user; email ``user<id>@example.test``; verified unless
  ``id % 3 = 0``; password-less (OAuth-only) when ``id % 5 = 0``.
* api_keys: one per (user, k % 3) over signup events (first event id is the key id);
  secret ``aa_live_<user>_<k % 3>``; revoked one day after creation when ``k % 4 = 0``.
* key_requests: every click event presents ``aa_live_<user>_<k % 3>`` (``sk_live_`` when
  ``k % 9 = 0``).
* sessions: one per view event, token ``session-<event id>``, 30-day expiry.
* identities: users with even id; google when ``id % 4 = 0`` else apple; subject ``sub-<id>``.
* oauth claims: one per customer; subject ``sub-<custkey % 300>``; email of user
  ``custkey % 300`` with case changes; unverified when ``custkey % 5 = 0``.
* consent events: signup events; allowed unless ``k % 3 = 0``.
* waitlist requests: one per customer; invalid when ``custkey % 13 = 0``; honeypot when
  ``custkey % 17 = 0``; ``custkey % 5 = 0`` repeats the previous customer's address;
  addresses of ``custkey % 4 = 0`` were already on the list before the batch.
* erasure requests: users with ``id % 10 = 0``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# 30-day sessions, the waitlist project key.
SESSION_MS = 30 * 86_400_000
DAY = 86_400_000
WAITLIST_PROJECT = "product-updates"


def accounts(users: DataFrame) -> DataFrame:
    i = F.col("id")
    return users.select(
        "id", "created_at",
        F.concat(F.lit("user"), i.cast("string"), F.lit("@example.test")).alias("email"),
        F.when(i % 3 != 0, F.col("created_at")).alias("email_verified_at"),
        (i % 5 != 0).alias("has_password"),
        F.lit(0).alias("ai_consent_version"),
        F.lit(None).cast("long").alias("ai_consent_at"))


def api_keys(ev0: DataFrame) -> DataFrame:
    k = F.col("k")
    s = (ev0.where(F.col("event_type") == "signup")
         .withColumn("secret", F.concat(F.lit("aa_live_"), F.col("user_id").cast("string"), F.lit("_"),
                                        (k % 3).cast("string"))))
    first = (s.groupBy("secret")
             .agg(F.min_by(F.struct("event_id", "user_id", "created_at", "k"), F.col("event_id")).alias("f")))
    return first.select(
        F.col("f.event_id").alias("id"), F.col("f.user_id").alias("user_id"),
        F.sha2(F.col("secret"), 256).alias("key_hash"), F.substring("secret", 1, 12).alias("prefix"),
        F.concat(F.lit("key "), (F.col("f.k") % 3).cast("string")).alias("name"),
        F.col("f.created_at").alias("created_at"),
        F.when(F.col("f.k") % 4 == 0, F.col("f.created_at") + DAY).alias("revoked_at"),
        (F.col("f.k") % 5 == 0).alias("can_mint"))


def key_requests(ev0: DataFrame) -> DataFrame:
    k = F.col("k")
    return (ev0.where(F.col("event_type") == "click")
            .select(F.col("event_id").alias("request_id"), F.col("created_at").alias("ts"),
                    F.concat(F.when(k % 9 == 0, "sk_live_").otherwise("aa_live_"),
                             F.col("user_id").cast("string"), F.lit("_"), (k % 3).cast("string"))
                    .alias("secret")))


def sessions(ev0: DataFrame) -> DataFrame:
    return (ev0.where(F.col("event_type") == "view")
            .select(F.sha2(F.concat(F.lit("session-"), F.col("event_id").cast("string")), 256).alias("token_hash"),
                    "user_id", (F.col("created_at") + SESSION_MS).alias("expires_at")))


def identities(users: DataFrame) -> DataFrame:
    i = F.col("id")
    return (users.where(i % 2 == 0)
            .select(F.when(i % 4 == 0, "google").otherwise("apple").alias("provider"),
                    F.concat(F.lit("sub-"), i.cast("string")).alias("subject"),
                    F.col("id").alias("user_id"),
                    F.concat(F.lit("user"), i.cast("string"), F.lit("@example.test")).alias("email"),
                    "created_at"))


def oauth_claims(customer: DataFrame) -> DataFrame:
    c = F.col("c_custkey")
    base = F.concat(F.lit("user"), (c % 300).cast("string"), F.lit("@example.test"))
    return customer.select(
        c.alias("claim_id"),
        F.when(c % 2 == 0, "google").otherwise("apple").alias("provider"),
        F.concat(F.lit("sub-"), (c % 300).cast("string")).alias("subject"),
        F.when(c % 3 == 0, F.upper(base)).otherwise(base).alias("email"),
        (c % 5 != 0).alias("email_verified"))


def consent_events(ev0: DataFrame) -> DataFrame:
    return (ev0.where(F.col("event_type") == "signup")
            .select("user_id", F.col("event_id").alias("id"), "created_at",
                    (F.col("k") % 3 != 0).alias("allowed")))


def waitlist_requests(customer: DataFrame) -> DataFrame:
    c = F.col("c_custkey")
    src = F.when(c % 5 == 0, c - 1).otherwise(c)
    addr = F.concat(F.lit("Customer."), src.cast("string"), F.lit("@Example.com"))
    raw = (F.when(c % 13 == 0, F.concat(F.lit("customer "), c.cast("string")))
           .when(c % 3 == 0, F.concat(F.lit("  "), F.upper(addr), F.lit(" ")))
           .otherwise(addr))
    return customer.select(c.alias("request_id"), raw.alias("raw_email"),
                           F.when(c % 17 == 0, "http://spam.example").otherwise("").alias("website"),
                           (c % 4 == 0).alias("pre_existing"))


def existing_waitlist(requests: DataFrame) -> DataFrame:
    """Rows already on the list before the batch (from the marked requests)."""
    return (requests.where(F.col("pre_existing"))
            .select(F.lower(F.regexp_replace(F.col("raw_email"), r"^\s+|\s+$", "")).alias("email"))
            .withColumn("project", F.lit(WAITLIST_PROJECT)).distinct())


def erasure_requests(users: DataFrame) -> DataFrame:
    return users.where(F.col("id") % 10 == 0).select(F.col("id").alias("user_id"))


def revoke_requests(ev0: DataFrame) -> DataFrame:
    """Key revocation requests: signup events with ``k % 7 = 0`` ask to revoke the key
    whose id is that event's id, two days later; odd ``k`` are sent by the next account
    (not the owner) and must have no effect."""
    k = F.col("k")
    return (ev0.where((F.col("event_type") == "signup") & (k % 7 == 0))
            .select(F.col("event_id").alias("key_id"),
                    F.when(k % 2 == 0, F.col("user_id")).otherwise(F.col("user_id") + 1).alias("user_id"),
                    (F.col("created_at") + 2 * DAY).alias("requested_at")))
