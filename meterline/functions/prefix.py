"""Running sums and minima per key, without a key's rows in one task.

The rows are range-partitioned by (key, order), so a key that holds a third of all rows is spread over many
partitions, and written once (range bounds are sampled anew each time a plan runs). Inside a partition the sums are a window over that
partition's share of a key; one total per (partition, key) carries them over to the next partitions. So a task
sorts one partition, and only as many totals as partitions meet for one key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterline.session import materialize


def ordered(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``df`` in range partitions of ``(key, *order)``, written, with ``_pid`` and ``_pos`` (place in that order)."""
    df = (df.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
          .withColumn("_pid", F.spark_partition_id()).withColumn("_pos", F.monotonically_increasing_id()))
    return materialize(df)


def running(df: DataFrame, key: str, sums: dict[str, str], lows: dict[str, str] | None = None) -> DataFrame:
    """Add running sums to the rows of ``ordered``: ``sums`` maps a new column to the column that it adds up, the row included.

    ``lows`` maps a new column to one of ``sums``: the least value of that sum over all earlier rows of the key (null: none).
    """
    lows = lows or {}
    part = Window.partitionBy("_pid", key).orderBy("_pos")
    upto, before = part.rowsBetween(Window.unboundedPreceding, 0), part.rowsBetween(Window.unboundedPreceding, -1)
    within = df.select("*", *[F.sum(F.col(c)).over(upto).alias(f"_s_{out}") for out, c in sums.items()])
    if lows:
        within = within.select("*", *[F.min(f"_s_{of}").over(before).alias(f"_m_{out}") for out, of in lows.items()])
    totals = within.groupBy("_pid", key).agg(
        *[F.sum(c).alias(f"_t_{out}") for out, c in sums.items()], *[F.min(f"_s_{of}").alias(f"_l_{out}") for out, of in lows.items()])
    earlier = Window.partitionBy(key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("*", *[F.coalesce(F.sum(f"_t_{out}").over(earlier), F.lit(0)).alias(f"_c_{out}") for out in sums])
    carried = carried.select("_pid", F.col(key).alias("_key"), *[f"_c_{out}" for out in sums], *[
        F.min(F.col(f"_l_{out}") + F.col(f"_c_{of}")).over(Window.partitionBy(key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))
        .alias(f"_p_{out}") for out, of in lows.items()])
    joined = within.join(carried.withColumnRenamed("_pid", "_in"), (F.col("_pid") == F.col("_in")) & F.col(key).eqNullSafe(F.col("_key")))
    return joined.select(
        *df.columns, *[(F.col(f"_s_{out}") + F.col(f"_c_{out}")).cast("long").alias(out) for out in sums],
        *[F.least(F.col(f"_m_{out}") + F.col(f"_c_{of}"), F.col(f"_p_{out}")).cast("long").alias(out) for out, of in lows.items()])
