"""Stateful streaming forms of the per-key folds (ST3, ST5) with ``applyInPandasWithState``.

State per key is a small tuple (balance; window count + reset time) kept in the state
store between micro-batches.  Within a micro-batch a key's rows are ordered by
(time, id) before folding; across micro-batches rows are applied in arrival order,
which is the service's own semantics (requests are handled as they arrive).  The
micro-batch size, not the key's history, bounds what one group holds in memory
(``maxFilesPerTrigger``, else ``maxBytesPerTrigger``, on the source).

Sinks are ``foreachBatch`` writes to ``<run>/out/batch=<id>`` with overwrite: a replayed
batch replaces its own output.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from meterline.sources.derived import base_events_from, ledger
from meterline.streaming.jobs import _await, _run_dir, event_stream

LIMIT_OUT = "key string, id long, ts long, window_start long, n long, allowed boolean"
LIMIT_STATE = "n long, reset long"
DEBIT_OUT = "id long, user_id long, accepted boolean, balance_after long"
DEBIT_STATE = "balance long"


def _limiter(window_ms: int, max_hits: int):
    def fold(key, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(pdfs)).sort_values(["ts", "id"])
        n, reset = state.get if state.exists else (0, None)
        out = []
        for hit_id, ts in zip(rows["id"].tolist(), rows["ts"].tolist()):
            if reset is None or reset < ts:
                n, reset = 1, ts + window_ms
            else:
                n += 1
            out.append((key[0], hit_id, ts, reset - window_ms, n, n <= max_hits))
        state.update((n, reset))
        yield pd.DataFrame(out, columns=["key", "id", "ts", "window_start", "n", "allowed"])
    return fold


def _debits(key, pdfs: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(pdfs)).sort_values(["created_at", "id"])
    balance = state.get[0] if state.exists else 0
    out = []
    for rid, amt in zip(rows["id"].tolist(), rows["amount_micros"].tolist()):
        ok = amt >= 0 or balance >= -amt
        if ok:
            balance += amt
        out.append((rid, key[0], ok, balance))
    state.update((balance,))
    yield pd.DataFrame(out, columns=["id", "user_id", "accepted", "balance_after"])


def _run(spark: SparkSession, name: str, stream: DataFrame) -> DataFrame:
    base = _run_dir(spark, name)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")

    q = (stream.writeStream.outputMode("append").foreachBatch(write)
         .option("checkpointLocation", f"{base}/_ck").trigger(availableNow=True).start())
    _await(q)
    return spark.read.parquet(f"{base}/out").drop("batch")


def rate_limit_stream(spark: SparkSession, sf_dir: str, window_ms: int, max_hits: int,
                      max_files: int | None = None, glob: str = "events.parquet") -> DataFrame:
    """ST5 streaming: one limiter per account over the event stream."""
    ev0 = base_events_from(event_stream(spark, sf_dir, max_files, glob))
    hits = ev0.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("id"),
                      F.col("created_at").alias("ts"))
    flagged = hits.groupBy("key").applyInPandasWithState(
        _limiter(window_ms, max_hits), LIMIT_OUT, LIMIT_STATE, "append", GroupStateTimeout.NoTimeout)
    return _run(spark, "ratelimit", flagged)


def conditional_debit_stream(spark: SparkSession, sf_dir: str, max_files: int | None = None,
                             glob: str = "events.parquet") -> DataFrame:
    """ST3 streaming: balance per user from the ledger rows derived from the event stream."""
    lg = ledger(base_events_from(event_stream(spark, sf_dir, max_files, glob))).select("id", "user_id", "created_at", "amount_micros")
    out = lg.groupBy("user_id").applyInPandasWithState(
        _debits, DEBIT_OUT, DEBIT_STATE, "append", GroupStateTimeout.NoTimeout)
    return _run(spark, "debits", out)
