"""S10 synthetic event generator (test fixtures): deterministic users and run events by
modular rules on ``spark.range`` -- generated on the executors, nothing on the driver.

``hot_share`` routes that fraction of all events to user 0, to exercise skew handling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = 86_400_000


def synthetic_events(spark: SparkSession, n_events: int, n_users: int, end_ms: int, days: int = 30,
                     hot_share: float = 0.0, partitions: int = 16) -> DataFrame:
    i = F.col("id")
    hot = (F.abs(F.xxhash64(i)) % 1000) < int(hot_share * 1000)
    user = F.when(hot, F.lit(0)).otherwise(F.abs(F.xxhash64(i, F.lit(7))) % n_users).cast("long")
    age_ms = (F.abs(F.xxhash64(i, F.lit(3))) % (days * DAY)).cast("long")
    failed = (F.abs(F.xxhash64(i, F.lit(5))) % 5) == 0
    return (spark.range(0, n_events, 1, partitions)
            .select(i.alias("id"),
                    F.when(failed, "run_failed").otherwise("run_succeeded").alias("event_name"),
                    user.alias("user_id"),
                    F.concat(F.lit("s"), (i % 4).cast("string")).alias("slug"),
                    F.when(failed, F.lit(402)).otherwise(F.lit(200)).alias("status"),
                    (i % 997).alias("duration_ms"),
                    F.lit("api").alias("source"),
                    (F.lit(end_ms) - 1 - age_ms).alias("created_at")))
