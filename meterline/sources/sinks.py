"""Batch sinks (S5, S6, S9): append-only writes that are safe to re-run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.session import materialize

ALLOWED_EVENT_COLUMNS = ["id", "event_name", "user_id", "slug", "status", "duration_ms", "source", "created_at"]
DAY = 86_400_000


def append_events(events: DataFrame, path: str) -> None:
    """Append only the allow-listed event columns (payloads are never persisted),
    partitioned by UTC day so period queries prune whole days."""
    (events.select(*ALLOWED_EVENT_COLUMNS).withColumn("day", F.expr(f"created_at div {DAY}"))
     .write.mode("append").partitionBy("day").parquet(path))


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there; a store that cannot be asked is an error, not an absence."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _existing(spark: SparkSession, path: str, key: str, schema) -> DataFrame | None:
    if not path_exists(spark, path):  # first write: nothing there yet
        return None
    return spark.read.schema(schema).parquet(path).select(key).where(F.col(key).isNotNull()).distinct()


def append_idempotent(rows: DataFrame, path: str, key: str, order: str) -> DataFrame:
    """S6 + J11 + W5: insert unless the external id already exists -- the first row per
    key in this batch (aggregate ``min_by``, no per-key sort) and only keys not yet in
    the target.  Rows without an external id conflict with nothing and are all inserted.
    Returns the rows that were appended: they are written out before the insert, so reading
    them later never looks at the (by then changed) target."""
    spark = rows.sparkSession
    first = (rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*rows.columns), F.col(order)).alias("_r"))
             .select("_r.*"))
    seen = _existing(spark, path, key, rows.schema)
    new = first if seen is None else first.join(seen, key, "left_anti")
    new = materialize(new.unionByName(rows.where(F.col(key).isNull())))
    new.write.mode("append").parquet(path)
    return new


def append_csv(rows: DataFrame, path: str) -> None:
    """Parsed answer rows appended to a CSV log (header-less, like the line log)."""
    rows.write.mode("append").option("header", "false").csv(path)
