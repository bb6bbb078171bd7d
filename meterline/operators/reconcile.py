"""Compare two keyed tables of amounts by a tree of hashes.

Both sides are reduced to one digest per bucket of keys (count, sum and exclusive or of row hashes, combined map-side); only buckets whose
digests differ are looked at again, in finer buckets, and only rows of the last differing buckets are joined. Where the
sides agree but for a few rows, nearly all rows are read and hashed, and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Buckets of each level. A level's differing buckets are at most this many numbers, which bounds what is broadcast.
LEVELS = (1 << 10, 1 << 16)


def _digests(df: DataFrame, buckets: int, side: str) -> DataFrame:
    h = F.xxhash64("key", "amount")
    return (df.groupBy(F.pmod("place", F.lit(buckets)).alias("bucket"))
            .agg(F.struct(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(38,0)")).alias("s")).alias(side)))


def differing(left: DataFrame, right: DataFrame, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """``(key, left_amount, right_amount)`` of every key whose amounts differ or that one side lacks (null there).

    Both sides: key (unique, not null), amount. Each side is read once a level, so it should be a written table.
    """
    left, right = (d.select("key", "amount", F.xxhash64("key").alias("place")) for d in (left, right))
    for buckets in levels:
        a, b = _digests(left, buckets, "a"), _digests(right, buckets, "b")
        bad = a.join(b, "bucket", "full").where(~F.col("a").eqNullSafe(F.col("b"))).select("bucket")
        bad = F.broadcast(bad)  # at most as many rows as buckets
        left, right = (d.join(bad, F.pmod("place", F.lit(buckets)) == F.col("bucket"), "left_semi") for d in (left, right))
    return (left.select("key", F.col("amount").alias("left_amount"))
            .join(right.select("key", F.col("amount").alias("right_amount")), "key", "full")
            .where(~F.col("left_amount").eqNullSafe(F.col("right_amount"))))


def balance_differences(ledger: DataFrame, stored: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """``(user_id, ledger_micros, stored_micros, diff_micros, kind)`` of the accounts whose stored balance is not their
    ledger's sum less their open reservations (``held``: user_id, open_micros).

    ``kind``: ``amount``, ``not_stored`` (ledger rows of an account without a balance) or ``no_ledger`` (a balance other than 0 without
    ledger rows). A sum of 0 without a stored balance, and the other way round, is no difference.
    """
    from meterline.session import materialize

    moves = ledger.select(F.col("user_id").alias("key"), "amount_micros")
    if held is not None:
        moves = moves.unionByName(held.select(F.col("user_id").alias("key"), (-F.col("open_micros")).alias("amount_micros")))
    sums = moves.where("key is not null").groupBy("key").agg(F.sum("amount_micros").alias("amount")).where("amount <> 0")
    kept = stored.where("balance_micros <> 0").select(F.col("user_id").alias("key"), F.col("balance_micros").alias("amount"))
    found = differing(materialize(sums), materialize(kept))
    diff = F.coalesce("right_amount", F.lit(0)) - F.coalesce("left_amount", F.lit(0))
    kind = F.when(F.col("right_amount").isNull(), "not_stored").when(F.col("left_amount").isNull(), "no_ledger").otherwise("amount")
    return found.select(F.col("key").alias("user_id"), F.col("left_amount").alias("ledger_micros"), F.col("right_amount").alias("stored_micros"),
                        diff.cast("long").alias("diff_micros"), kind.alias("kind"))
