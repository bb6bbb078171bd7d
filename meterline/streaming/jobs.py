"""Structured Streaming forms of the event and payment jobs (S5, S6, ST4, ST7, ST9-ST11).

Every job reads the driver's Parquet ``events`` as a file stream, runs with
``trigger(availableNow=True)`` (bounded catch-up, restartable from its checkpoint) and
writes to a sink under the session's shared checkpoint folder
(``spark.checkpoint.dir``).  Each equals its batch form on a finished input:

* ``ingest_events``      ST9 + S5: derive run-outcome events, append allow-listed columns only.
* ``daily_counts``       ST10: tumbling UTC days; per micro-batch the day's run and failure
                         counts and its distinct (day, user) pairs are written and added
                         up by the read, so an event counts however late it arrives.
* ``weekly_rollup``      ST11: chained aggregation -- (user, day) success pairs per
                         micro-batch, then the weekly repeat-users aggregate over the rollup.
* ``checkout_stream``    ST4 + ST7 + S6: paid deliveries, inside ``foreachBatch`` one per
                         session, anti-joined against the sessions already written (a
                         replay of any age) and semi-joined with the users snapshot (late rows for deleted
                         accounts are acknowledged without effect).

Micro-batch writes go to ``<sink>/batch=<id>`` with overwrite, so a batch replayed
after a failure replaces its own output: the sinks are idempotent.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.session import checkpoint_dir, materialize
from meterline.sources.derived import analytics_events, base_events_from, checkout_feed
from meterline.sources.tables import SCHEMAS

DAY = 86_400_000
ALLOWED_EVENT_COLUMNS = ["id", "event_name", "user_id", "slug", "status", "duration_ms", "source", "created_at"]


def _run_dir(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex[:12]}"


# Bytes of the files of a micro-batch, unless their number is given: this bounds what a task holds of one key.
MAX_BYTES = 256 << 20


def event_stream(spark: SparkSession, sf_dir: str, max_files: int | None = None,
                 name: str = "events.parquet") -> DataFrame:
    """The events table (one file, or a folder of part files) as a stream (explicit schema, no inference), some files a trigger."""
    r = spark.readStream.schema(SCHEMAS["events"])
    r = r.option("maxFilesPerTrigger", max_files) if max_files else r.option("maxBytesPerTrigger", MAX_BYTES)
    # braces make it a pattern: the file source takes a plain path for a folder only
    return r.parquet(f"{sf_dir.rstrip('/')}/{{{name}}}")


def _await(q) -> None:
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


def ingest_events(spark: SparkSession, sf_dir: str, out: str | None = None) -> str:
    """ST9 + S5: authenticated run outcomes, allow-listed columns, partitioned by UTC day."""
    base = _run_dir(spark, "ingest") if out is None else out
    ev = analytics_events(base_events_from(event_stream(spark, sf_dir)))
    runs = (ev.where(F.col("event_name").isin("run_succeeded", "run_failed") & F.col("user_id").isNotNull())
            .select(*ALLOWED_EVENT_COLUMNS).withColumn("day", F.expr(f"created_at div {DAY}")))
    q = (runs.writeStream.format("parquet").outputMode("append").partitionBy("day")
         .option("path", f"{base}/data").option("checkpointLocation", f"{base}/_checkpoint")
         .trigger(availableNow=True).start())
    _await(q)
    return f"{base}/data"


def daily_counts(spark: SparkSession, sf_dir: str, max_files: int | None = None) -> DataFrame:
    """ST10: per UTC day -- runs, failures and exact active users; late events count too."""
    base = _run_dir(spark, "daily")
    ev = analytics_events(base_events_from(event_stream(spark, sf_dir, max_files)))
    runs = (ev.where(F.col("event_name").isin("run_succeeded", "run_failed") & F.col("user_id").isNotNull())
            .select(F.expr(f"created_at div {DAY}").alias("day"), "user_id", "event_name"))
    schema = "day long, user_id long, runs long, failures long"
    spark.createDataFrame([], schema).write.parquet(f"{base}/daily/batch=-1")  # a table even if no event comes

    def write(batch: DataFrame, batch_id: int) -> None:
        # one row per (day, user): its counts in this batch; a replayed batch replaces its own
        (batch.groupBy("day", "user_id")
         .agg(F.count_if(F.col("event_name") == "run_succeeded").alias("runs"),
              F.count_if(F.col("event_name") == "run_failed").alias("failures"))
         .write.mode("overwrite").parquet(f"{base}/daily/batch={batch_id}"))

    _await(runs.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/_ck")
           .trigger(availableNow=True).start())
    users = (spark.read.schema(schema).parquet(f"{base}/daily").groupBy("day", "user_id")
             .agg(F.sum("runs").alias("runs"), F.sum("failures").alias("failures")))
    return users.groupBy("day").agg(F.sum("runs").alias("runs"), F.sum("failures").alias("failures"),
                                    F.count_if(F.col("runs") > 0).alias("active"))


def weekly_rollup(spark: SparkSession, sf_dir: str) -> str:
    """ST11 (first stage): distinct (user, day) success pairs appended per micro-batch."""
    base = _run_dir(spark, "weekly")
    ev = analytics_events(base_events_from(event_stream(spark, sf_dir)))
    ok = ev.where((F.col("event_name") == "run_succeeded") & F.col("user_id").isNotNull())

    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.select("user_id", F.expr(f"created_at div {DAY}").alias("day"), "created_at")
         .groupBy("user_id", "day").agg(F.min("created_at").alias("created_at"))
         .write.mode("overwrite").parquet(f"{base}/pairs/batch={batch_id}"))

    q = ok.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/_ck").trigger(availableNow=True).start()
    _await(q)
    return f"{base}/pairs"


def checkout_stream(spark: SparkSession, sf_dir: str, users: DataFrame, existing_sessions: DataFrame,
                    max_files: int | None = None) -> DataFrame:
    """ST4 + ST7 + S6: idempotent card-checkout credits from a replaying webhook stream.

    Returns the ledger rows written (session_id, user_id, credit_micros)."""
    from meterline.operators.ledger import CHECKOUT_TYPES, safe_positive_int

    base = _run_dir(spark, "checkout")
    feed = checkout_feed(base_events_from(event_stream(spark, sf_dir, max_files)))
    valid = (feed.where(F.col("type").isin(*CHECKOUT_TYPES) & (F.col("payment_status") == "paid"))
             .withColumn("user_id", safe_positive_int(F.col("meta_user_id")))
             .withColumn("credit_micros", safe_positive_int(F.col("meta_credit")))
             .where(F.col("user_id").isNotNull() & F.col("credit_micros").isNotNull()))
    known_users = materialize(users.select(F.col("id").alias("user_id")))  # both snapshots are read in every micro-batch
    sink = f"{base}/ledger"
    spark.createDataFrame([], "session_id string, user_id long, credit_micros long") \
        .write.mode("overwrite").parquet(f"{sink}/batch=-1")
    seen0 = materialize(existing_sessions.select("session_id").distinct())

    def write(batch: DataFrame, batch_id: int) -> None:
        done = spark.read.parquet(sink).where(F.col("batch") != batch_id).select("session_id")
        rows = (batch.join(known_users, "user_id", "left_semi")           # ST7
                .join(seen0, "session_id", "left_anti")                    # S6 vs the ledger
                .join(done, "session_id", "left_anti")                     # replays of earlier batches
                .groupBy("session_id").agg(F.min_by(F.struct("user_id", "credit_micros"),
                                                    F.col("arrival")).alias("r"))
                .select("session_id", "r.user_id", "r.credit_micros"))
        rows.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    q = valid.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/_ck").trigger(availableNow=True).start()
    _await(q)
    return spark.read.parquet(sink).drop("batch")
