"""Identity, credentials, sessions and waitlist (J7, J8, J14, J15, F12-F15, F19, K6, K7,
O9, O10, W5, X1, X2, X9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterline.functions.keys import spread_nulls
from meterline.functions.text import JS_TRIM, JS_WS

# Email pattern and length cap, API key prefix.
_PART = rf"[^@{JS_WS[1:-1]}]+"
EMAIL_RE = rf"^{_PART}@{_PART}\.{_PART}\z"
MAX_EMAIL = 254
KEY_PREFIX = "aa_live_"


def normalise_email(c):
    """Trim (all leading/trailing whitespace, as the service's trim) + lower-case."""
    return F.lower(F.regexp_replace(c, JS_TRIM, ""))


def valid_email(c):
    """The service's email pattern and length cap (on the normalised value)."""
    return c.rlike(EMAIL_RE) & (F.length(c) <= MAX_EMAIL)


def identity_resolution(claims: DataFrame, identities: DataFrame, accounts: DataFrame,
                        registry: DataFrame) -> DataFrame:
    """J14 + O9 + O2: resolve each sign-in claim (in ``claim_id`` order) against the snapshot.

    login    -- (provider, subject) already linked;
    rejected -- no verified email;
    linked   -- an account with that email (case-insensitive) exists: identity added;
                an unverified account with a password gets it disabled (claimed) and its
                sessions ended, otherwise it is marked verified;
    created  -- a new account, numbered above the registry's high-water mark.
    In-batch effects of earlier claims: a repeated (provider, subject) after a successful
    first claim is a login to that claim's account; a later claim for an email created
    earlier in the batch links to the new account.  "First" is found with aggregates.
    """
    from meterline.operators.privacy import id_allocation
    from meterline.session import materialize

    idn = identities.select("provider", "subject", F.col("user_id").alias("identity_user"))
    acc = accounts.select(F.lower(F.col("email")).alias("email_key"), F.col("id").alias("account_id"),
                          (F.col("email_verified_at").isNull() & F.col("has_password")).alias("unconfirmed"))
    c = (claims.withColumn("email_key", F.lower(F.col("email")))
         .join(idn, ["provider", "subject"], "left")
         .withColumn("_k", spread_nulls(F.col("email_key"), F.col("claim_id"), string=True))
         .join(acc.withColumnRenamed("email_key", "_k"), "_k", "left").drop("_k"))
    verified = F.col("email").isNotNull() & F.col("email_verified")
    c = c.withColumn("base", F.when(F.col("identity_user").isNotNull(), "login")
                     .when(~verified, "rejected")
                     .when(F.col("account_id").isNotNull(), "linked").otherwise("created"))
    c = materialize(c)  # read by two aggregates and three joins below
    fs = (c.where(F.col("base") != "rejected").groupBy("provider", "subject")
          .agg(F.min("claim_id").alias("fsc")))
    c = c.join(fs, ["provider", "subject"], "left") \
        .withColumn("batch_login", (F.col("base") != "login") & F.coalesce(F.col("fsc") < F.col("claim_id"),
                                                                            F.lit(False)))
    fe = (c.where((F.col("base") == "created") & ~F.col("batch_login")).groupBy("email_key")
          .agg(F.min("claim_id").alias("fec")))
    c = c.join(fe, "email_key", "left")
    action1 = (F.when(F.col("batch_login"), "login")
               .when((F.col("base") == "created") & (F.col("fec") < F.col("claim_id")), "linked")
               .otherwise(F.col("base")))
    c = materialize(c.withColumn("action", action1))  # read by the numbering and the joins below
    new_ids = id_allocation(c.where(F.col("action") == "created").select("claim_id"), registry, ["claim_id"]) \
        .select(F.col("claim_id").alias("owner"), F.col("id").alias("new_id"))
    # The claim whose new account this claim uses: itself when created, the first claim
    # with the same email when linked within the batch.  One join resolves both.
    owner = (F.when(F.col("action") == "created", F.col("claim_id"))
             .when((F.col("action") == "linked") & F.col("account_id").isNull(), F.col("fec")))
    c = c.withColumn("owner", owner).join(new_ids, "owner", "left")
    c = c.withColumn("uid1", F.when(F.col("batch_login"), F.lit(None).cast("long"))
                     .otherwise(F.coalesce("identity_user", "account_id", "new_id")))
    firsts = c.select(F.col("claim_id").alias("fsc"), F.col("uid1").alias("fs_uid"))
    c = c.join(firsts, "fsc", "left")
    return c.select("claim_id", "provider", "subject", "action",
                    F.when((F.col("action") == "linked") & ~F.col("batch_login") & F.col("fec").isNull(),
                           F.coalesce(F.col("unconfirmed"), F.lit(False)))
                    .otherwise(F.lit(False)).alias("password_disabled"),
                    F.when(F.col("batch_login"), F.col("fs_uid")).otherwise(F.col("uid1")).alias("user_id"))


def active_keys(keys: DataFrame, accounts: DataFrame, key_uses: DataFrame) -> DataFrame:
    """J7 + F12 + K6 + O10: unrevoked keys of existing accounts, last use touched in, each
    user's newest first (K6 orders within a user; no total order over all users)."""
    last = key_uses.groupBy("key_id").agg(F.max("ts").alias("last_used_at"))
    live = keys.where(F.col("revoked_at").isNull()).join(
        accounts.select(F.col("id").alias("user_id")), "user_id", "inner")
    return (live.join(last, live["id"] == last["key_id"], "left")
            .select("user_id", "id", "prefix", "name", "created_at", "last_used_at", "can_mint")
            .repartition("user_id").sortWithinPartitions("user_id", F.desc("id")))


def key_lookup(requests: DataFrame, keys: DataFrame, accounts: DataFrame) -> DataFrame:
    """J15 + X2 + X9: presented secret -> account, via prefix precheck and SHA-256 digest
    equality with an unrevoked key (no secret is ever stored or joined in clear)."""
    r = requests.withColumn("key_hash", F.when(F.col("secret").startswith(KEY_PREFIX),
                                               F.sha2(F.col("secret"), 256)))
    # Requests without the key prefix have no digest: spread them (see spread_nulls).
    r = r.withColumn("_k", spread_nulls(F.col("key_hash"), F.col("request_id"), string=True))
    k = (keys.where(F.col("revoked_at").isNull()).select(F.col("id").alias("key_id"), F.col("key_hash").alias("_k"),
                                                         "user_id")
         .join(accounts.select(F.col("id").alias("user_id")), "user_id", "left_semi"))
    return r.join(k, "_k", "left").select("request_id", "ts", "key_id", "user_id")


def live_sessions(sessions: DataFrame, accounts: DataFrame, now_ms: int) -> DataFrame:
    """J8 + F13: sessions of existing accounts not yet expired (``expires_at >= now``)."""
    return (sessions.where(F.col("expires_at") >= F.lit(now_ms))
            .join(accounts.select(F.col("id").alias("user_id"), "email"), "user_id", "inner"))


def purge_sessions(sessions: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """``(kept, purged)``; what expired before ``now`` goes, a session without an expiry stays."""
    gone = F.coalesce(F.col("expires_at") < F.lit(now_ms), F.lit(False))
    return sessions.where(~gone), sessions.where(gone)


def linked_providers(identities: DataFrame) -> DataFrame:
    """K7: each account's providers, alphabetical."""
    return identities.groupBy("user_id").agg(F.sort_array(F.collect_set("provider")).alias("providers"))


def waitlist_dedupe(requests: DataFrame, existing: DataFrame, project: str) -> DataFrame:
    """F19 + J11 + W5: validate, normalise and insert-once per (project, email).

    status: honeypot (hidden field filled), invalid, already (on the list before, or an
    earlier request in this batch), joined.
    """
    r = requests.withColumn("email", normalise_email(F.col("raw_email")))
    ok = (F.coalesce(F.col("website"), F.lit("")) == "") & valid_email(F.col("email"))
    known = existing.where(F.col("project") == project).select("email").distinct() \
        .withColumn("known", F.lit(True))
    first = (r.where(ok).groupBy("email").agg(F.min("request_id").alias("first_request")))
    j = r.join(known, "email", "left").join(first, "email", "left")
    status = (F.when(F.coalesce(F.col("website"), F.lit("")) != "", "honeypot")
              .when(~valid_email(F.col("email")), "invalid")
              .when(F.col("known").isNotNull(), "already")
              .when(F.col("first_request") == F.col("request_id"), "joined").otherwise("already"))
    return j.select("request_id", F.when(status.isin("joined", "already"), F.col("email")).alias("email"),
                    F.lit(project).alias("project"), status.alias("status"))


def window_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """W5 (small-group form): first row per key by arrival."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def soft_revoke(keys: DataFrame, requests: DataFrame) -> DataFrame:
    """``revoked_at`` set from revocation requests that name both the key id and its
    owner (a request by anyone else changes nothing); the latest request wins, as
    successive ``UPDATE ... WHERE id = ? AND user_id = ?`` statements would leave it.
    ``requests``: key_id, user_id, requested_at."""
    hits = (requests.join(keys.select(F.col("id").alias("key_id"), "user_id"), ["key_id", "user_id"], "left_semi")
            .groupBy("key_id").agg(F.max("requested_at").alias("_req")))
    j = keys.join(hits, keys["id"] == hits["key_id"], "left")
    return j.select(*[F.coalesce(F.col("_req"), F.col("revoked_at")).alias("revoked_at") if c == "revoked_at"
                      else keys[c] for c in keys.columns])


def end_claimed_sessions(sessions: DataFrame, resolution: DataFrame) -> DataFrame:
    """When a verified sign-in claims an unconfirmed account (its password is turned
    off), that account's existing sessions end -- the sessions left afterwards."""
    claimed = resolution.where(F.col("password_disabled")).select("user_id").distinct()
    return sessions.join(claimed, "user_id", "left_anti")
