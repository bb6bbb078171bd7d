"""The service's relational model, derived from the driver's ``events`` table.

The analytics/billing jobs operate on the service tables (``analytics_events``,
``users``, ``ledger``, ``app_store_transactions``, ``analytics_state``).  These are
derived here from the driver's Parquet ``events`` with narrow projections only (no
shuffle) except ``users`` (one aggregate by user).  The identical definitions in
DuckDB SQL live in ``meterline.plans.oracle`` so both engines see the same rows.

Epoch conversion: ``unix_micros(CAST(ts AS TIMESTAMP)) div 1000`` with the session
time zone pinned to UTC (floors; DuckDB's ``epoch_ms`` would round).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.sources.tables import read_table

DAY = 86_400_000

# Fixed values of the derivation (see FIXTURES.md §B): event type -> event name,
# k-modulo rules for status, slug, source, store environment and ledger channel.
FAILED_STATUS_BY_K_MOD_4 = {0: 402, 1: 422, 2: 429, 3: 502}
NULL_USER_K = 97
TRACKING_STARTED_AT = 1_704_067_200_000  # 2024-01-01T00:00Z


def epoch_ms(ts: str) -> Column:
    """Timestamp column -> epoch milliseconds (floor), UTC session time zone."""
    return F.expr(f"unix_micros(CAST({ts} AS TIMESTAMP)) div 1000")


def ts_literal(ms: int) -> Column:
    """Epoch-ms literal as TIMESTAMP_NTZ (UTC wall clock), comparable to the raw ``ts``."""
    return F.expr(f"CAST(timestamp_millis({int(ms)}) AS TIMESTAMP_NTZ)")


def base_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ev0: event_id, created_at (epoch ms), user_id, event_type, value, k."""
    return base_events_from(read_table(spark, sf_dir, "events"))


def base_events_from(ev: DataFrame) -> DataFrame:
    return ev.select(
        "event_id",
        epoch_ms("ts").alias("created_at"),
        "user_id", "event_type", "value",
        F.expr("""try_cast(regexp_extract(props, '"k": ([0-9]+)', 1) AS INT)""").alias("k"),
    )


def analytics_events(ev0: DataFrame) -> DataFrame:
    k = F.col("k")
    et = F.col("event_type")
    status_failed = (F.when(k % 4 == 0, 402).when(k % 4 == 1, 422)
                     .when(k % 4 == 2, 429).otherwise(502))
    return ev0.select(
        F.col("event_id").alias("id"),
        F.when(et == "error", "run_failed").when(et.isin("click", "view"), "run_succeeded")
         .otherwise(et).alias("event_name"),
        F.when(k == NULL_USER_K, F.lit(None).cast("long")).otherwise(F.col("user_id")).alias("user_id"),
        F.concat(F.lit("wf-"), (k % 6).cast("string")).alias("slug"),
        F.when(et.isin("click", "view"), F.lit(200))
         .when(et == "error", status_failed).cast("int").alias("status"),
        F.when(k % 10 == 0, F.lit(None).cast("long"))
         .otherwise(F.floor(F.col("value") * 10).cast("long")).alias("duration_ms"),
        F.when(k % 11 == 0, F.lit(None).cast("string"))
         .when(k % 3 == 0, "iphone-app").when(k % 3 == 1, "shortcut-key")
         .otherwise("api").alias("source"),
        "created_at",
    )


def users(ev0: DataFrame) -> DataFrame:
    """Signups staggered over 20 days after a user's first event (one aggregate by user)."""
    return (ev0.groupBy("user_id")
            .agg(F.min("created_at").alias("first_seen"))
            .select(F.col("user_id").alias("id"),
                    (F.col("first_seen") + (F.col("user_id") % 20) * DAY).alias("created_at")))


def store_transactions(ev0: DataFrame) -> DataFrame:
    k = F.col("k")
    prod = (k % 5) == 3
    env = F.when(prod, "Production").otherwise("Sandbox")
    return (ev0.where((F.col("event_type") == "purchase") & ((k % 5) >= 3))
            .select(F.concat(env, F.lit(":"), F.col("event_id").cast("string")).alias("id"),
                    "user_id", env.alias("environment")))


def ledger(ev0: DataFrame) -> DataFrame:
    k5 = F.col("k") % 5
    purchase = F.col("event_type") == "purchase"
    eid = F.col("event_id").cast("string")
    return (ev0.where(F.col("event_type").isin("purchase", "click", "view"))
            .select(F.col("event_id").alias("id"), "user_id",
                    F.when(purchase, "topup").otherwise("usage").alias("kind"),
                    F.when(purchase, F.floor(F.col("value") * 1_000_000))
                     .otherwise(-F.floor(F.col("value") * 1000)).cast("long").alias("amount_micros"),
                    F.when(purchase & (k5 == 0), F.concat(F.lit("cs_test_"), eid))
                     .when(purchase & (k5 == 1), F.concat(F.lit("cs_live_"), eid))
                     .alias("stripe_session_id"),
                    F.when(purchase & (k5 == 3), F.concat(F.lit("purchase:Production:"), eid))
                     .when(purchase & (k5 == 4), F.concat(F.lit("purchase:Sandbox:"), eid))
                     .alias("apple_event_id"),
                    "created_at"))


# Fixed values of the usage-request derivation (click/view events are metered requests):
# k % 8 picks the request kind, k % 4 the text model (3 = a model no longer sold).
USAGE_TEXT_MODELS = {0: "@cf/meta/llama-3.3-70b-instruct-fp8-fast",
                     1: "@cf/mistralai/mistral-small-3.1-24b-instruct",
                     2: "@cf/meta/llama-3.1-8b-instruct-fp8-fast",
                     3: "retired/model-x"}


def usage_requests(ev0: DataFrame) -> DataFrame:
    """Metered requests: one per click/view event, with request shape and reported usage."""
    k = F.col("k")
    v = F.col("value")

    def fl(x, m):
        return F.floor(x * m).cast("long")

    kind = (F.when(k % 8 == 0, "audio").when(k % 8 == 1, "image").when(k % 8 == 2, "classifier")
            .otherwise("text"))
    text_model = F.when(k % 4 == 0, USAGE_TEXT_MODELS[0]).when(k % 4 == 1, USAGE_TEXT_MODELS[1]) \
        .when(k % 4 == 2, USAGE_TEXT_MODELS[2]).otherwise(USAGE_TEXT_MODELS[3])
    model = (F.when(k % 8 == 0, "@cf/openai/whisper-large-v3-turbo").when(k % 8 == 1, "gpt-image-2")
             .when(k % 8 == 2, "typesafe/jev").otherwise(text_model))
    nul = F.lit(None)
    return (ev0.where(F.col("event_type").isin("click", "view"))
            .select(F.col("event_id").alias("id"), "user_id", kind.alias("kind"), model.alias("model"),
                    F.when(k % 5 == 0, nul.cast("double")).when(k % 5 == 1, F.lit(-5.0))
                     .when(k % 5 == 2, F.lit(9000.0)).otherwise((k * 40).cast("double"))
                     .alias("requested_max_tokens"),
                    fl(v, 500).alias("body_chars"),
                    (k % 3).alias("images"),
                    F.when(k % 7 == 0, nul.cast("long")).otherwise(fl(v, 40)).alias("input_tokens"),
                    F.when(k % 7 == 0, nul.cast("long")).otherwise(fl(v, 9)).alias("output_tokens"),
                    fl(v, 60).alias("response_chars"),
                    fl(v, 100000).alias("audio_bytes"),
                    F.when(k % 6 == 0, nul.cast("long")).otherwise(fl(v, 2)).alias("audio_seconds"),
                    F.when(k % 13 == 0, F.concat(F.lit("AiError: "), (3000 + k % 50).cast("string"),
                                                 F.lit(": upstream rejected")))
                     .when(k % 13 == 1, F.lit("Error 5006: content blocked by safety policy"))
                     .when(k % 13 == 2, F.lit("network timeout"))
                     .alias("provider_error"),
                    "created_at"))


ATTEMPT_GAP = 20_000  # milliseconds between the login attempts of one event


def login_attempts(ev0: DataFrame) -> DataFrame:
    """Login attempts: every event comes with ``1 + k % 16`` of them, 20 s apart, from one of five shared networks."""
    k = F.col("k")
    return (ev0.select(F.concat(F.lit("net-"), (F.col("user_id") % 5).cast("string")).alias("key"), "event_id", "created_at",
                       F.explode(F.sequence(F.lit(0), (F.coalesce(k, F.lit(0)) % 16).cast("int"))).alias("i"))
            .select("key", (F.col("event_id") * 16 + F.col("i")).alias("id"), (F.col("created_at") + F.col("i") * ATTEMPT_GAP).alias("ts")))


def opening_balances(ev0: DataFrame) -> DataFrame:
    """Balance of every account before its first event."""
    return ev0.select("user_id").distinct().select("user_id", ((F.col("user_id") % 5) * 4000).cast("long").alias("balance_micros"))


def small_credits(ev0: DataFrame) -> DataFrame:
    """Credits of about the size of a few runs, one per purchase event."""
    return ev0.where(F.col("event_type") == "purchase").select(
        "user_id", F.col("created_at").alias("at"), F.col("event_id").alias("id"), F.floor(F.col("value") * 500).cast("long").alias("amount_micros"))


def stored_balances(ev0: DataFrame) -> DataFrame:
    """Stored balance of every account with ledger rows, with planted faults: 1,000 micros too much where ``id % 37 = 0``, no row where
    ``id % 41 = 0``; and a balance of 5 for an account without ledger rows for every id divisible by 43."""
    u = F.col("user_id")
    sums = ledger(ev0).groupBy("user_id").agg(F.sum("amount_micros").alias("b"))
    own = sums.where(u % 41 != 0).select("user_id", (F.col("b") + F.when(u % 37 == 0, 1000).otherwise(0)).cast("long").alias("balance_micros"))
    return own.unionByName(sums.where(u % 43 == 0).select((u + 10_000_000).alias("user_id"), F.lit(5).cast("long").alias("balance_micros")))


def metered_requests(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Admitted requests as runs: settled ``1000 + 37 * (id % 1000)`` ms later; every 19th id is still open."""
    from meterline.operators.pricing import metered_outcomes

    r = metered_outcomes(usage, prices, "created_at").where(F.col("reserved_micros").isNotNull())
    done = F.when(F.col("id") % 19 != 0, F.col("created_at") + 1000 + 37 * (F.col("id") % 1000))
    return r.select("id", "user_id", F.col("created_at").alias("at"), "reserved_micros", "actual_micros", done.alias("settled_at"))


LEDGER_CUTOFF = 1_705_276_800_000  # 2024-01-15T00:00Z: ledger rows before it are "already written"


def checkout_feed(ev0: DataFrame) -> DataFrame:
    """Card checkout webhook deliveries (all metadata as strings), with replays.

    Fixed rules: k % 7 = 0 expired sessions, k % 9 = 0 unpaid, k % 23 in (0, 1, 2)
    malformed / unknown user ids, k % 17 in 0..5 malformed or non-positive credit;
    k % 4 = 0 deliveries are sent twice (second copy 1 s later).
    """
    k = F.col("k")
    base = ev0.where((F.col("event_type") == "purchase") & (k % 5).isin(0, 1))
    cols = [
        F.concat(F.when(k % 5 == 1, "cs_live_").otherwise("cs_test_"), F.col("event_id").cast("string"))
        .alias("session_id"),
        F.when(k % 7 == 0, "checkout.session.expired").when(k % 2 == 0, "checkout.session.completed")
        .otherwise("checkout.session.async_payment_succeeded").alias("type"),
        F.when(k % 9 == 0, "unpaid").otherwise("paid").alias("payment_status"),
        F.when(k % 23 == 0, "0").when(k % 23 == 1, "1.5").when(k % 23 == 2, "999999")
        .otherwise(F.col("user_id").cast("string")).alias("meta_user_id"),
        F.when(k % 17 == 0, "Infinity").when(k % 17 == 1, "1e6").when(k % 17 == 2, "-1")
        .when(k % 17 == 3, "9007199254740992").when(k % 17 == 4, "not-a-number").when(k % 17 == 5, "0")
        .otherwise((F.floor(F.col("value")).cast("long") * 1_000_000).cast("string")).alias("meta_credit"),
    ]
    # One scan: each delivery row fans out to itself and, for replayed sessions, a copy
    # 1 s later (explode of a 1-2 element array), instead of a second scan + union.
    copies = F.when(k % 4 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (base.select(*cols, "created_at", F.explode(copies).alias("delivery"))
            .select("session_id", "type", "payment_status", "meta_user_id", "meta_credit",
                    (F.col("created_at") + F.col("delivery") * 1000).alias("arrival"), "delivery"))


DAY2 = 2 * DAY


def account_token(id_col: Column) -> Column:
    """O11 deterministic variant: the account token is sha256 of the decimal id (lower hex)."""
    return F.sha2(id_col.cast("string"), 256)


def store_feed(ev0: DataFrame) -> DataFrame:
    """Store transaction events (purchase / replay / refund / reversal / stale refund /
    refund-before-delivery), one row per delivered signed state.

    Fixed rules on k: 19 other bundle, 29 non-consumable, 31 family shared, 37 quantity 2,
    41 unknown product, 43 Xcode environment, 47 another account's token, 53 no token,
    59 malformed id; k % 2 = 0 token upper-cased (matching is case-insensitive).
    Event variants: 0 delivery; 1 replay (k % 8 = 0, +500 ms); 2 refund (k % 3 = 0, +2 d);
    3 reversal (k % 6 = 0, +3 d); 4 stale refund (k % 12 = 0, arrives +4 d, signed +1 d);
    5 refund before delivery (k % 7 = 0, arrives -1 s, signed +1 ms); 6 the same
    transaction presented by the next account id with that account's token (k % 23 = 4, +1 s).
    """
    k, ca = F.col("k"), F.col("created_at")
    b = ev0.where((F.col("event_type") == "purchase") & (k % 5).isin(3, 4))
    amount = (F.when(k % 4 == 0, "5").when(k % 4 == 1, "10").when(k % 4 == 2, "25").otherwise("50"))
    tok = account_token(F.col("user_id"))
    b = b.select(
        "event_id", "user_id", "k", "created_at",
        F.when(k % 59 == 0, F.concat(F.col("event_id").cast("string"), F.lit("/x")))
         .otherwise(F.col("event_id").cast("string")).alias("transaction_id"),
        F.when(k % 19 == 0, "com.other.app").otherwise("com.example.credits").alias("bundle_id"),
        F.when(k % 29 == 0, "Non-Consumable").otherwise("Consumable").alias("type"),
        F.when(k % 31 == 0, "FAMILY_SHARED").otherwise("PURCHASED").alias("ownership"),
        F.when(k % 37 == 0, 2).otherwise(1).alias("quantity"),
        F.when(k % 41 == 0, "unknown").otherwise(F.concat(F.lit("com.example.credits"), amount))
         .alias("product_id"),
        F.when(k % 5 == 3, "Production").when(k % 43 == 0, "Xcode").otherwise("Sandbox").alias("environment"),
        F.when(k % 47 == 0, account_token(F.col("user_id") + 1)).when(k % 53 == 0, F.lit(None).cast("string"))
         .when(k % 2 == 0, F.upper(tok)).otherwise(tok).alias("app_account_token"))
    variants = [  # seq, filter, arrival offset, signed offset, revoked
        (0, None, 0, 0, False), (1, k % 8 == 0, 500, 0, False), (2, k % 3 == 0, DAY2, DAY2, True),
        (3, k % 6 == 0, 3 * DAY, 3 * DAY, False), (4, k % 12 == 0, 4 * DAY, DAY, True),
        (5, k % 7 == 0, -1000, 1, True),
        (6, k % 23 == 4, 1000, 0, False)]  # the same transaction presented by the next account
    # One scan of the purchases: every row fans out into the variants that apply to it
    # (explode of a small array of structs), instead of one scan per variant + union.
    fan = F.filter(F.array(*[F.struct(F.lit(seq).alias("seq"), F.lit(arr).cast("long").alias("arr"),
                                      F.lit(sig).cast("long").alias("sig"), F.lit(rev).alias("rev"),
                                      (F.lit(True) if cond is None else cond).alias("on"))
                             for seq, cond, arr, sig, rev in variants]), lambda v: v["on"])
    e = b.select("*", F.explode(fan).alias("v"))
    seq = F.col("v.seq")
    other = seq == 6
    return e.select((F.col("event_id") * 8 + seq).alias("id"),
                    F.when(other, F.col("user_id") + 1).otherwise(F.col("user_id")).alias("user_id"),
                    "transaction_id", "bundle_id", "type", "ownership", "quantity", "product_id", "environment",
                    F.when(other, account_token(F.col("user_id") + 1)).otherwise(F.col("app_account_token"))
                    .alias("app_account_token"),
                    seq.alias("seq"), F.col("v.rev").alias("revoked"), (ca + F.col("v.sig")).alias("signed_date"),
                    (ca + F.col("v.arr")).alias("arrival"))


SESSION7_MS = 7 * DAY


def prior_transactions(ev0: DataFrame) -> DataFrame:
    """Transactions delivered before a stream begins, of every 29th purchase: owned by an account that does not exist any more in the
    feed (its id plus 20,000,000), or by nobody where the state's id is divisible by 3 (a tombstone)."""
    s = store_feed(ev0).where((F.col("seq") == 0) & (F.expr("id div 8") % 29 == 0))
    owner = F.when(F.col("id") % 3 != 0, F.col("user_id") + 20_000_000)
    return s.select(owner.alias("user_id"), F.concat("environment", F.lit(":"), "transaction_id").alias("transaction_id"), F.lit(0).alias("revoked"),
                    F.col("signed_date").alias("last_signed"), F.lit(1).cast("long").alias("revision"), F.lit(0).cast("long").alias("removed"),
                    F.lit(0).cast("long").alias("credit")).dropDuplicates(["transaction_id"])


def analytics_state(spark: SparkSession, tracking_started_at: int = TRACKING_STARTED_AT) -> DataFrame:
    """The one scalar state row (``tracking_started_at``)."""
    return spark.createDataFrame([("tracking_started_at", tracking_started_at)], "key string, value long")


class Model:
    """Lazy handle on the derived service tables of one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.ev0 = base_events(spark, sf_dir)

    @property
    def events(self) -> DataFrame:
        return analytics_events(self.ev0)

    def events_between(self, lo: int | None = None, hi: int | None = None) -> DataFrame:
        """Events with ``lo <= created_at < hi``, bounded on the raw ``ts`` column as well.

        ``created_at = floor(micros / 1000)``, so ``created_at >= lo`` is exactly
        ``ts >= lo ms`` and ``created_at < hi`` is exactly ``ts < hi ms``.  Stating the
        bounds on ``ts`` lets them reach the Parquet scan (row-group pruning) while
        the derived-column predicate of each query stays as written.
        """
        ev = self.ev0
        raw = read_table(self.spark, self.sf_dir, "events")
        cond = F.lit(True)
        if lo is not None:
            cond = cond & (F.col("ts") >= ts_literal(lo))
        if hi is not None:
            cond = cond & (F.col("ts") < ts_literal(hi))
        ev = base_events_from(raw.where(cond))
        return analytics_events(ev)

    @property
    def users(self) -> DataFrame:
        return users(self.ev0)

    @property
    def ledger(self) -> DataFrame:
        return ledger(self.ev0)

    @property
    def store_transactions(self) -> DataFrame:
        return store_transactions(self.ev0)

    @property
    def usage(self) -> DataFrame:
        return usage_requests(self.ev0)

    @property
    def checkout_feed(self) -> DataFrame:
        return checkout_feed(self.ev0)

    @property
    def store_feed(self) -> DataFrame:
        return store_feed(self.ev0)

    @property
    def state(self) -> DataFrame:
        return analytics_state(self.spark)

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)


def tracking_since(state: DataFrame, now_ms: int) -> int:
    """``tracking_started_at`` from the one-row state table, ``now`` when missing.
    A 1-row scalar: reading it on the driver is bounded by construction."""
    row = (state.where(F.col("key") == "tracking_started_at")
           .agg(F.coalesce(F.max("value"), F.lit(int(now_ms))).alias("v")).first())
    return int(row.v)
