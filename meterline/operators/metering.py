"""Metered runs against a balance (ST3, P6): reserve the worst case, settle the actual cost, 402 where the credit does not cover it.

A rejected reservation takes nothing, so acceptance depends on everything before it. But most of it is decided without a fold:

* Let ``q`` be the opening balance plus all credits less all reservations so far, refunds left out. A reservation after which ``q`` is
  not a new low below zero is accepted whatever went before: since the last low some credits came in, the balance was not
  negative then, and every reservation since has been covered by those credits.
* Let ``base`` be the balance if only those sure reservations had been made. Any further one can only lower it, so a
  reservation above ``base`` is rejected.

Both are running sums (``functions.prefix``, a key's rows spread over all tasks). Only the reservations in between, new lows that ``base`` covers, are
folded in order, with ``base`` as an input; all other rows of the account never enter the fold.

Order within an account: time, then credits, settlements, reservations, then id. A run without a settlement keeps its reservation open.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.functions.prefix import ordered, running
from meterline.session import materialize

CREDIT, SETTLE, RESERVE = 0, 1, 2
_ORDER = ["at", "step", "id"]


def _movements(runs: DataFrame, credits: DataFrame, opening: DataFrame) -> DataFrame:
    """``(user_id, at, step, id, amount, actual)``: credits (the opening balance is the first one), reservations and settlements."""
    none = F.lit(None).cast("long")
    first = opening.select("user_id", F.lit(-(1 << 62)).cast("long").alias("at"), F.lit(CREDIT).alias("step"), F.lit(-1).cast("long").alias("id"),
                           F.col("balance_micros").alias("amount"), none.alias("actual"))
    added = credits.select("user_id", "at", F.lit(CREDIT).alias("step"), "id", F.col("amount_micros").alias("amount"), none.alias("actual"))
    actual = F.least("actual_micros", "reserved_micros")
    steps = F.array(F.struct(F.col("at").alias("at"), F.lit(RESERVE).alias("step"), F.col("reserved_micros").alias("amount")),
                    F.struct(F.col("settled_at").alias("at"), F.lit(SETTLE).alias("step"), (F.col("reserved_micros") - actual).alias("amount")))
    used = runs.select("user_id", "id", actual.alias("actual"), F.explode(F.filter(steps, lambda s: s["at"].isNotNull())).alias("s"))
    return first.unionByName(added).unionByName(used.select("user_id", "s.at", "s.step", "id", "s.amount", "actual"))


def _fold(unsure: DataFrame) -> DataFrame:
    """``(id, accepted)`` of the reservations that depend on each other, in order; ``base`` is the balance without any of them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, taken, held = object(), 0, set()
        for pdf in batches:
            out = []
            for u, step, i, amount, base in zip(*(pdf[c].tolist() for c in ("user_id", "step", "id", "amount", "base"))):
                if u != user:
                    user, taken, held = u, 0, set()
                if step == RESERVE:
                    ok = base - taken >= amount
                    if ok:
                        taken += amount
                        held.add(i)
                    out.append((i, ok))
                elif i in held:
                    held.discard(i)
                    taken -= amount
            yield pd.DataFrame(out, columns=["id", "accepted"])

    rows = unsure.select("user_id", *_ORDER, "amount", "base").repartition("user_id").sortWithinPartitions("user_id", *_ORDER)
    return rows.mapInPandas(run, "id long, accepted boolean")


def metered_runs(runs: DataFrame, credits: DataFrame, opening: DataFrame) -> DataFrame:
    """``(user_id, at, step, id, accepted, moved_micros, charged_micros, balance_micros)``: every movement and the balance after it.

    ``runs``: id (unique), user_id, at, reserved_micros, actual_micros, settled_at (null: still open, else later than ``at``).
    ``credits``: user_id, at, id, amount_micros (0 or more). ``opening``: user_id (unique), balance_micros (0 or more).
    ``step``: 0 credit (the opening balance has id -1), 1 settlement, 2 reservation. ``accepted`` is null for credits; a run that was not
    accepted is a 402. ``charged_micros`` is what a settlement books in the ledger.
    """
    rows = ordered(_movements(runs, credits, opening), "user_id", _ORDER)
    low = F.when(F.col("step") == CREDIT, F.col("amount")).when(F.col("step") == RESERVE, -F.col("amount")).otherwise(F.lit(0).cast("long"))
    flagged = running(rows.withColumn("_q", low), "user_id", {"q": "_q"}, {"least": "q"})
    sure = F.col("q") >= F.least(F.coalesce("least", F.lit(0).cast("long")), F.lit(0).cast("long"))
    marks = materialize(flagged.where(F.col("step") == RESERVE).select("id", sure.alias("sure")))
    marked = rows.join(marks.withColumnRenamed("id", "run"), (rows["step"] != CREDIT) & (rows["id"] == F.col("run")), "left").drop("run")

    def moved(accepted):
        signed = F.when(F.col("step") == RESERVE, -F.col("amount")).otherwise(F.col("amount"))
        return F.when(F.coalesce(accepted, F.lit(True)), signed).otherwise(F.lit(0).cast("long"))

    based = running(marked.withColumn("_b", moved(F.col("sure"))), "user_id", {"base": "_b"})
    based = materialize(based.where("not sure").select("user_id", *_ORDER, "amount", "base"))
    covered = based.where((F.col("step") == RESERVE) & (F.col("base") >= F.col("amount"))).select(F.col("id").alias("run"))
    decided = _fold(based.join(covered, based["id"] == F.col("run"), "left_semi")).where("accepted").select(F.col("id").alias("run"), "accepted")
    known = marked.join(decided, (marked["step"] != CREDIT) & (marked["id"] == F.col("run")), "left")
    accepted = F.when(F.col("step") != CREDIT, F.col("sure") | F.coalesce("accepted", F.lit(False)))
    final = known.withColumn("accepted", accepted).withColumn("moved_micros", moved(F.col("accepted"))).drop("run", "sure")
    charged = F.when((F.col("step") == SETTLE) & F.col("accepted"), F.col("actual"))
    return running(final, "user_id", {"balance_micros": "moved_micros"}).select(
        "user_id", "at", "step", "id", "accepted", "moved_micros", charged.alias("charged_micros"), "balance_micros")


def ledger_rows(moved: DataFrame) -> DataFrame:
    """What the runs and credits book: top-ups with their amount, uses with the charged cost (rows of 0 are not booked)."""
    use = F.col("step") == SETTLE
    amount = F.when(use, -F.col("charged_micros")).otherwise(F.col("moved_micros"))
    return (moved.where((F.col("step") == CREDIT) | (use & (F.col("charged_micros") > 0)))
            .select("user_id", "at", "id", F.when(use, "usage").otherwise("topup").alias("kind"), amount.alias("amount_micros")))


def open_reservations(moved: DataFrame) -> DataFrame:
    """``(user_id, open_micros)``: accepted reservations that are not settled, per account."""
    return (moved.where((F.col("step") != CREDIT) & F.col("accepted")).groupBy("user_id", "id")
            .agg((-F.sum(F.when(F.col("step") == RESERVE, F.col("moved_micros")))).alias("held"), F.count(F.lit(1)).alias("n"))
            .where("n = 1").groupBy("user_id").agg(F.sum("held").alias("open_micros")))
