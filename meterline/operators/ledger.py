"""Credit ledger jobs.

The ledger is append-only; a user's balance is the sum of their ledger rows (minus
open reservations, which have no ledger rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterline.functions.keys import spread_nulls
from meterline.functions.text import JS_TRIM

HOUR = 3_600_000
# Largest safe integer of the service's number type; checkout event types
# that fulfil a payment.
MAX_SAFE_INTEGER = 9_007_199_254_740_991
CHECKOUT_TYPES = ("checkout.session.completed", "checkout.session.async_payment_succeeded")


def usd(micros: Column, digits: int = 2) -> Column:
    """Micro-dollars as ``$x.xx`` (fixed digits, sign before the dollar sign)."""
    return F.concat(F.when(micros < 0, "-$").otherwise("$"), fixed_text(F.abs(micros).cast("long"), digits))


def fixed_text(micros: Column, digits: int = 2) -> Column:
    """``(micros / 1e6).toFixed(digits)`` of a non-negative integer: the exact value of the double is
    rounded, so a decimal tie goes to the side on which its nearest double lies.

    Only ties need the double: its fraction is split in two parts of at most 27 bits, whose
    products with the scale are exact, and compared with the tie.
    """
    unit = 10 ** (6 - digits)

    def above(m: Column) -> Column:
        def parts(frac: Column) -> Column:
            return bound(F.floor(frac * F.lit(float(1 << 26))) / F.lit(float(1 << 26)), lambda high: (
                high * scale - tie) + (frac - high) * scale >= 0)
        scale = F.lit(float(10 ** (digits + 1)))
        tie = ((m % 1_000_000) / F.lit(unit / 10)).cast("double")
        return bound(bound(m / F.lit(1_000_000.0), lambda v: v - F.floor(v)), parts)

    def rounded(m: Column) -> Column:
        rest = m % unit
        return F.floor(m / F.lit(unit)).cast("long") + F.when(rest * 2 > unit, 1).when(rest * 2 < unit, 0).when(above(m), 1).otherwise(0)

    def text(n: Column) -> Column:
        whole = F.floor(n / F.lit(10 ** digits)).cast("long")
        return F.concat(whole.cast("string"), F.lit("."), F.lpad((n % 10 ** digits).cast("string"), digits, "0"))

    return bound(bound(micros, rounded), text)


def history_amount(micros: Column) -> Column:
    """Amount of a history row: its sign, four digits below a cent (10,000 micros) and two from there."""
    return bound(F.abs(micros), lambda m: F.concat(F.when(micros > 0, "+").otherwise("\u2212"), F.lit("$"), F.when(
        m < 10_000, fixed_text(m, 4)).otherwise(fixed_text(m, 2))))


def ledger_balances(ledger: DataFrame, users: DataFrame) -> DataFrame:
    """Balance per user = sum of ledger rows (users without rows have 0)."""
    sums = ledger.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_rows"),
                                         F.sum("amount_micros").alias("balance_micros"))
    return (users.select(F.col("id").alias("user_id")).join(sums, "user_id", "left")
            .select("user_id", F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"),
                    F.coalesce("balance_micros", F.lit(0)).cast("long").alias("balance_micros"))
            .withColumn("negative", F.col("balance_micros") < 0))


def running_balance(ledger: DataFrame) -> DataFrame:
    """Balance after each ledger row, ordered by (created_at, id), with a negative flag.

    Two-level prefix sum so no user's whole history is sorted in one task: hour-bucket
    totals get a per-user running offset (one row per user-hour), and rows are summed
    only within their (user, hour) bucket.  Exact: offset(bucket) + within-bucket sum.
    """
    lg = ledger.select("id", "user_id", "created_at", "amount_micros") \
        .withColumn("bucket", F.expr(f"created_at div {HOUR}"))
    buckets = lg.groupBy("user_id", "bucket").agg(F.sum("amount_micros").alias("bsum"))
    w_off = Window.partitionBy("user_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.withColumn("offset", F.coalesce(F.sum("bsum").over(w_off), F.lit(0))).drop("bsum")
    w_in = (Window.partitionBy("user_id", "bucket").orderBy("created_at", "id")
            .rowsBetween(Window.unboundedPreceding, 0))
    return (lg.withColumn("within", F.sum("amount_micros").over(w_in))
            .join(offsets, ["user_id", "bucket"])
            .select("id", "user_id", "created_at", "amount_micros",
                    (F.col("offset") + F.col("within")).cast("long").alias("balance_micros"))
            .withColumn("negative", F.col("balance_micros") < 0))


def user_history(ledger: DataFrame, n: int = 25) -> DataFrame:
    """W4 + K5: each user's newest ``n`` ledger rows (id desc).

    ``row_number() <= n`` lets Spark insert a partial WindowGroupLimit before the
    shuffle, so a hot user sends at most ``n`` rows per map task.
    """
    w = Window.partitionBy("user_id").orderBy(F.desc("id"))
    return (ledger.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)
            .select("user_id", "rn", "id", "kind", "amount_micros", "created_at"))


def bound(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` evaluated once, however often ``fn`` names it (a plain expression would repeat it)."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def safe_positive_int(s: Column) -> Column:
    """F16 / note 17: JS ``Number(x)`` that is a safe integer > 0, else NULL."""

    def number(t: Column) -> Column:
        decimal = t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z")  # not Java's 1d, 5f, NaN
        base = (F.when(t.rlike(r"^0[xX][0-9a-fA-F]+\z"), 16).when(t.rlike(r"^0[oO][0-7]+\z"), 8)
                .when(t.rlike(r"^0[bB][01]+\z"), 2))
        # 2^53 has 54 binary, 18 octal, 14 hexadecimal digits: longer ones (leading zeros apart) are not safe
        body = F.regexp_replace(F.substring(t, 3, 1 << 30), r"^0+(?=.)", "")
        whole = bound(F.struct(base.alias("base"), body.alias("body")), lambda x: F.coalesce(
            *[F.when((x["base"] == b) & (F.length(x["body"]) <= most), F.conv(x["body"], b, 10)) for b, most in ((16, 14), (8, 18), (2, 54))]))
        return F.when(decimal, t.try_cast("double")).when(t.rlike("^0[xXoObB]"), whole.cast("double"))

    def safe(d: Column) -> Column:
        return F.when(d.isNotNull() & ~F.isnan(d) & (d >= 1) & (d <= F.lit(float(MAX_SAFE_INTEGER)))
                      & ((d % F.lit(1.0)) == 0), d.cast("long"))

    return bound(bound(F.regexp_replace(s, JS_TRIM, ""), number), safe)


def checkout_fulfilment(feed: DataFrame, existing_ledger: DataFrame, users: DataFrame) -> DataFrame:
    """F16 + J10 + J11 + W5 + S6: one outcome per delivered checkout event.

    Outcomes: ignored (other event type), not_paid, invalid_metadata, unknown_account
    (late payment for a deleted/unknown id), replay (session already in the ledger, or an
    earlier delivery in this feed credited it), credited.  The first delivery per session
    is picked with an aggregate (``min`` of (arrival, delivery)), which pre-aggregates a
    replay storm of one session before the shuffle instead of sorting it in one task.
    """
    f = (feed.withColumn("uid", safe_positive_int(F.col("meta_user_id")))
         .withColumn("credit", safe_positive_int(F.col("meta_credit"))))
    known = existing_ledger.where(F.col("stripe_session_id").isNotNull()) \
        .select(F.col("stripe_session_id").alias("session_id")).distinct() \
        .withColumn("in_ledger", F.lit(True))
    accounts = users.select(F.col("id").alias("_k")).withColumn("account", F.lit(True))
    # Malformed metadata gives a NULL uid; spread those rows instead of sending them all
    # to the NULL partition of the account lookup.
    f = (f.join(known, "session_id", "left")
         .withColumn("_k", spread_nulls(F.col("uid"), F.col("session_id"), F.col("arrival"), F.col("delivery")))
         .join(accounts, "_k", "left").drop("_k"))
    eligible = (F.col("type").isin(*CHECKOUT_TYPES) & (F.col("payment_status") == "paid")
                & F.col("uid").isNotNull() & F.col("credit").isNotNull()
                & F.col("account").isNotNull() & F.col("in_ledger").isNull())
    firsts = (f.where(eligible).groupBy("session_id")
              .agg(F.min(F.struct("arrival", "delivery")).alias("first")))
    f = f.join(firsts, "session_id", "left")
    is_first = (F.col("first.arrival") == F.col("arrival")) & (F.col("first.delivery") == F.col("delivery"))
    outcome = (F.when(~F.col("type").isin(*CHECKOUT_TYPES), "ignored")
               .when(F.col("payment_status") != "paid", "not_paid")
               .when(F.col("uid").isNull() | F.col("credit").isNull(), "invalid_metadata")
               .when(F.col("account").isNull(), "unknown_account")
               .when(F.col("in_ledger").isNotNull(), "replay")
               .when(is_first, "credited").otherwise("replay"))
    return f.select("session_id", "delivery", "arrival", F.col("uid").alias("user_id"),
                    outcome.alias("outcome"),
                    F.when(outcome == "credited", F.col("credit")).alias("credited_micros"),
                    F.when(outcome == "credited", F.concat(F.lit("Added "), usd(F.col("credit")),
                                                           F.lit(" credit"))).alias("description"))


def balance_upsert(balances: DataFrame, credits: DataFrame) -> DataFrame:
    """Keyed upsert -- new balance = old + credited delta (users without credit unchanged)."""
    deltas = credits.where(F.col("outcome") == "credited").groupBy("user_id") \
        .agg(F.sum("credited_micros").alias("delta"))
    return (balances.join(deltas, "user_id", "left")
            .select("user_id", F.col("balance_micros").alias("old_balance_micros"),
                    (F.col("balance_micros") + F.coalesce("delta", F.lit(0))).cast("long")
                    .alias("balance_micros")))
