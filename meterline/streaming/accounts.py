"""Account state as streams with ``transformWithState``: store purchases (ST1, ST2, J12) and session expiry (ST6, F14).

State lives in the state store, per key: of an account its balance and a map of its transactions, of a transaction its owner, of a share of the
sessions their expiries. What exists before the stream begins is given as initial state: opening balances, transactions already
delivered, and tombstones (transactions whose account was deleted; they are never delivered again). Sessions are kept in shares by hash.

A micro-batch is bounded by ``max_files`` / ``max_bytes`` of the source; within it the rows of a key are applied in arrival order, across
micro-batches in the order in which they come. Output goes to ``<run>/out/batch=<id>``, overwritten when a batch is repeated.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from meterline.operators import folds
from meterline.streaming.jobs import _await, _run_dir

TX = ["revoked", "last_signed", "revision", "removed", "credit"]
TX_SCHEMA = "revoked int, last_signed long, revision long, removed long, credit long"
EVENT_SCHEMA = ("user_id long, id long, transaction_id string, credit_micros long, revoked boolean, signed_date long, arrival long, "
                "amount_micros long, source string")
SESSION_STATE = "token_hash string, user_id string, expires_at long"
SHARDS = 512  # shares of the sessions: each is a key of the state store


def _in_order(rows: Iterator[pd.DataFrame], order: list[str]) -> list[dict]:
    """The rows of one key and micro-batch, in arrival order."""
    return sorted((r for pdf in rows for r in pdf.to_dict("records")), key=lambda r: tuple(r[c] for c in order))


class Owners(StatefulProcessor):
    """Key: transaction. The first account that presents it keeps it; rows of any other account are dropped."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.owner = handle.getValueState("owner", "user_id long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        owner, kept = self.owner.get()[0] if self.owner.exists() else None, []
        for r in _in_order(rows, ["arrival", "id"]):
            if owner is None:
                owner = int(r["user_id"])
                self.owner.update((owner,))
            if r["user_id"] == owner:
                kept.append(r)
        if kept:
            yield pd.DataFrame(kept)

    def close(self) -> None:
        pass


class Purchases(StatefulProcessor):
    """Key: account. The purchase state machine over a balance and a map of transactions."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.balance = handle.getValueState("balance", "micros long")
        self.tx = handle.getMapState("tx", "id string", TX_SCHEMA)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for r in initialState.to_dict("records"):
            if r["transaction_id"] is None:
                self.balance.update((int(r["balance_micros"]),))
            else:
                self.tx.updateValue((r["transaction_id"],), tuple(int(r[c]) for c in TX))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = {"balance": self.balance.get()[0] if self.balance.exists() else 0, "tx": {}}
        out, touched = [], set()
        for r in _in_order(rows, ["arrival", "source", "id"]):
            tid = r["transaction_id"] if r["source"] == "store" else None
            if tid is not None and tid not in touched:
                touched.add(tid)
                if self.tx.containsKey((tid,)):
                    state["tx"][tid] = dict(zip(TX, self.tx.getValue((tid,))))
            made = folds._purchase_step(state, r)
            if made is not None:
                out.append(made)
        self.balance.update((int(state["balance"]),))
        for tid in touched:
            self.tx.updateValue((tid,), tuple(int(state["tx"][tid][c]) for c in TX))
        if out:
            yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def initial_state(balances: DataFrame, transactions: DataFrame) -> DataFrame:
    """``balances``: user_id, balance_micros; ``transactions``: user_id, transaction_id and the state columns. Tombstones (no user) hold none."""
    none = [F.lit(None).cast(t).alias(c) for c, t in (p.split(" ") for p in TX_SCHEMA.split(", "))]
    return (balances.select("user_id", F.lit(None).cast("string").alias("transaction_id"), "balance_micros", *none)
            .unionByName(transactions.where("user_id IS NOT NULL").select("user_id", "transaction_id", F.lit(0).cast("long").alias("balance_micros"), *TX)))


def purchase_stream(spark: SparkSession, store_events: DataFrame, ledger_events: DataFrame, balances: DataFrame,
                    transactions: DataFrame) -> DataFrame:
    """ST1 over streams of accepted store states and ledger rows; the columns of ``folds.purchase_states``.

    States of a transaction that another account already owns, or whose account was deleted (a tombstone among
    ``transactions``), have no effect.
    """
    none = F.lit(None)
    base = _run_dir(spark, "purchases")
    known = transactions.select(F.col("transaction_id").alias("_t"), F.col("user_id").alias("_owner"), F.lit(True).alias("_known"))
    store = (store_events.join(known, F.col("transaction_id") == F.col("_t"), "left")
             .where(F.col("_known").isNull() | (F.col("user_id") == F.col("_owner")))
             .select("user_id", "id", "transaction_id", "credit_micros", "revoked", "signed_date", "arrival",
                     none.cast("long").alias("amount_micros"), F.lit("store").alias("source")))
    owned = store.groupBy("transaction_id").transformWithStateInPandas(Owners(), EVENT_SCHEMA, "Append", "None")
    moved = ledger_events.select("user_id", "id", none.cast("string").alias("transaction_id"), none.cast("long").alias("credit_micros"),
                                 none.cast("boolean").alias("revoked"), none.cast("long").alias("signed_date"), "arrival", "amount_micros",
                                 F.lit("ledger").alias("source"))
    states = owned.unionByName(moved).groupBy("user_id").transformWithStateInPandas(
        Purchases(), folds.PURCHASE_SCHEMA, "Append", "None", initialState=initial_state(balances, transactions).groupBy("user_id"))
    return _collected(spark, states, base, folds.PURCHASE_SCHEMA)


class Expiry(StatefulProcessor):
    """Key: a share of the sessions. The list holds the live ones; one timer, at the first end of a life, purges all that have ended.

    A state call costs a round trip to the JVM, so it is made for a share and not for a session.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.live = handle.getListState("live", SESSION_STATE)
        self.due = handle.getValueState("due", "at long")

    def _wait(self, ends: int) -> None:
        """The timer of the share, not later than ``ends``: it fires once the watermark has passed it."""
        due = self.due.get()[0] if self.due.exists() else None
        if due is None or ends < due:
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(ends)
            self.due.update((ends,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last: dict = {}
        for pdf in rows:
            for token, user, ends in zip(pdf["token_hash"].tolist(), pdf["user_id"].tolist(), pdf["expires_at"].tolist()):
                rank = (ends, user is not None, int(user or 0))
                if token not in last or rank > last[token][0]:
                    last[token] = (rank, user)
        self.live.appendList([(token, user, rank[0]) for token, (rank, user) in last.items()])
        self._wait(min(rank[0] for rank, _ in last.values()))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, held = timerValues.getCurrentWatermarkInMs(), {}
        for token, user, ends in self.live.get():  # in the order in which they came: of equal ends the first stays
            if token not in held or ends > held[token][1]:
                held[token] = (user, ends)
        over = [(token, user, ends) for token, (user, ends) in held.items() if ends < now]
        left = [(token, user, ends) for token, (user, ends) in held.items() if ends >= now]
        self.due.clear()
        if left:
            self.live.put(left)
            self._wait(min(ends for _, _, ends in left))
        else:
            self.live.clear()
        if over:
            yield pd.DataFrame(over, columns=["token_hash", "user_id", "expires_at"])

    def close(self) -> None:
        pass


def expired_sessions(spark: SparkSession, sessions: DataFrame, delay: str = "0 seconds", shards: int = SHARDS) -> DataFrame:
    """ST6 + F14: the sessions that expired before the latest event time of the stream, purged from the state.

    ``sessions``: token_hash, user_id, created_at, expires_at (epoch ms; a later row of a session extends it; a null end never comes). What is not
    purged is live. A row that comes more than ``delay`` behind the latest event time is not taken in; the purge waits as long.
    A task holds the live sessions of one of the ``shards`` at a time.
    """
    base = _run_dir(spark, "sessions")
    timed = sessions.withColumn("ts", F.timestamp_millis("created_at")).withWatermark("ts", delay).where("expires_at IS NOT NULL")
    # user ids travel as strings: beside nulls pandas has no long
    shared = timed.withColumn("user_id", F.col("user_id").cast("string")).withColumn("shard", F.pmod(F.xxhash64("token_hash"), F.lit(shards)))
    purged = shared.groupBy("shard").transformWithStateInPandas(Expiry(), SESSION_STATE, "Append", "EventTime")
    out = "token_hash string, user_id long, expires_at long"
    return _collected(spark, purged.withColumn("user_id", F.col("user_id").cast("long")), base, out)


def _collected(spark: SparkSession, stream: DataFrame, base: str, schema: str) -> DataFrame:
    spark.createDataFrame([], schema).write.parquet(f"{base}/out/batch=-1")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={batch_id}")

    _await(stream.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", f"{base}/_ck")
           .trigger(availableNow=True).start())
    return spark.read.schema(schema).parquet(f"{base}/out").drop("batch")
