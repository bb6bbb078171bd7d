"""O4 against a stored table: balances merged by rewriting only the buckets that a batch touches.

Accounts lie in ``buckets`` folders by hash. A folder holds the balances of its accounts and the ids of the events that made them, and
a merge replaces whole folders (dynamic partition overwrite), so a folder is never in between: if a merge breaks off, the folders already replaced
know their events and the same batch, sent again, changes only the others. Sending a batch twice changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.session import materialize

SCHEMA = "user_id long, event_id long, balance_micros long, bucket int"


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("user_id"), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, path: str) -> None:
    (rows.select("user_id", "event_id", "balance_micros", "bucket").repartition("bucket").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path))


def create(balances: DataFrame, path: str, buckets: int = 64) -> None:
    """A new table of ``balances`` (user_id, balance_micros) under ``path``, without any event."""
    _write(balances.select("user_id", F.lit(None).cast("long").alias("event_id"), F.col("balance_micros").cast("long").alias("balance_micros"))
           .withColumn("bucket", _bucket(buckets)), path)


def merge(spark: SparkSession, path: str, deltas: DataFrame, buckets: int = 64) -> int:
    """Add ``deltas`` (event_id, user_id, amount_micros) that the table does not know; returns the number of folders replaced.

    Copies of an event within the batch count once. An account without a balance begins at 0. Rows without an event or account are left out.
    """
    new = (deltas.where("event_id IS NOT NULL AND user_id IS NOT NULL").groupBy("event_id")
           .agg(F.first(F.struct("user_id", "amount_micros")).alias("d"))
           .select("event_id", "d.user_id", "d.amount_micros").withColumn("bucket", _bucket(buckets)))
    table = spark.read.schema(SCHEMA).parquet(path)
    known = table.where("event_id IS NOT NULL").select("bucket", "event_id")
    new = materialize(new.join(known, ["bucket", "event_id"], "left_anti"))
    touched = [r[0] for r in new.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
    if not touched:
        return 0
    kept = table.where(F.col("bucket").isin(touched))  # prunes the other folders
    sums = new.select("user_id", "bucket", F.col("amount_micros").alias("balance_micros"))
    balances = (kept.where("event_id IS NULL").select("user_id", "bucket", "balance_micros").unionByName(sums)
                .groupBy("bucket", "user_id").agg(F.sum("balance_micros").cast("long").alias("balance_micros"))
                .withColumn("event_id", F.lit(None).cast("long")))
    events = kept.where("event_id IS NOT NULL").select("user_id", "event_id", "bucket").unionByName(new.select("user_id", "event_id", "bucket"))
    rows = balances.unionByName(events.withColumn("balance_micros", F.lit(None).cast("long")))
    _write(materialize(rows), path)  # what is read is not what is replaced
    return len(touched)


def balances(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path).where("event_id IS NULL").select("user_id", "balance_micros")
