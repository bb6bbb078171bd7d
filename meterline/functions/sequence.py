"""Exact consecutive numbering in a global order without a single-partition window.

``row_number()`` over an un-partitioned window moves every row into one task.  Here:
range-partition on the order and sort inside each partition; ``monotonically_increasing_id``
then encodes (partition id << 33) + position in the partition, computed JVM-side in the
same stage.  That numbered frame is written once (reliable checkpoint): range bounds are
sampled and partitions are laid out anew each time a plan runs, so the counts and the rows
must come from the same written result.  Counting rows per partition gives one small row per
partition; a window over those few rows turns them into offsets, and offset + position is the global number.
Exact and fully distributed: only ``#partitions`` numbers pass through a single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterline.session import materialize

_LOW33 = (1 << 33) - 1


def global_sequence(df: DataFrame, order: list[str], out: str = "seq", start: int = 1) -> DataFrame:
    """Add ``out`` = start, start+1, ... following ``order`` (which must be a total order)."""
    mid = F.monotonically_increasing_id()
    local = (df.repartitionByRange(*order).sortWithinPartitions(*order)
             .withColumn("_mid", mid)
             .withColumn("_pid", F.shiftright(F.col("_mid"), 33))
             .withColumn("_pos", F.col("_mid").bitwiseAND(F.lit(_LOW33)))
             .drop("_mid"))
    local = materialize(local)
    counts = local.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.withColumn(
        "_off", F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
                           F.lit(0))).select("_pid", "_off")
    # ``offsets`` has one row per partition: its size is bounded by the partition count.
    return (local.join(F.broadcast(offsets), "_pid")
            .withColumn(out, (F.col("_off") + F.col("_pos") + F.lit(start)).cast("long"))
            .drop("_pid", "_off", "_pos"))
