"""Order-dependent per-key folds (ST1-ST3, ST5, ST8, W7).

These operators are not associative (a debit that fails does not consume; a refund
removes only what the balance still holds; a limiter window opens at the first hit),
so they run as a streaming fold over each key's events in arrival order:

    df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(fold)

The fold keeps O(1) state per *current* key and carries it across Arrow batches, so a
heavy key is streamed through, never materialised as one pandas group
(``applyInPandas`` would load the whole group into memory).  Spark hash-partitions the
keys across tasks; only the per-key sequence itself is sequential.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.sources import dims as D


def ordered_fold(df: DataFrame, key: str, order: list[str], schema: str,
                 make_state: Callable[[], object],
                 step: Callable[[object, dict], dict | None]) -> DataFrame:
    """Run ``step(state, row) -> out_row | None`` over each key's rows in ``order``."""
    cols = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cur_key, state = object(), None
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False, name=None):
                r = dict(zip(cols, row))
                k = r[key]
                if k != cur_key:
                    cur_key, state = k, make_state()
                o = step(state, r)
                if o is not None:
                    out.append(o)
            if out:
                yield pd.DataFrame(out)
    return (df.repartition(key).sortWithinPartitions(key, *order)
            .mapInPandas(run, schema))


# ---- ST3 conditional debits -----------------------------------------------------------

def _debit_state():
    return {"balance": 0}


def _debit_step(st, r):
    amt = int(r["amount_micros"])
    if amt >= 0:
        st["balance"] += amt
        ok = True
    else:
        ok = st["balance"] >= -amt
        if ok:
            st["balance"] += amt
    return {"id": int(r["id"]), "user_id": int(r["user_id"]), "accepted": ok,
            "balance_after": st["balance"]}


def conditional_debits(events: DataFrame) -> DataFrame:
    """ST3: credits always apply; a debit applies only if the balance covers it.

    ``events``: id, user_id, created_at, amount_micros (credit > 0, debit < 0).
    """
    e = events.select("id", "user_id", "created_at", "amount_micros")
    return ordered_fold(e, "user_id", ["created_at", "id"],
                        "id long, user_id long, accepted boolean, balance_after long",
                        _debit_state, _debit_step)


# ---- ST5 hit-anchored fixed-window limiter --------------------------------------------

def rate_limit_flags(hits: DataFrame, window_ms: int, max_hits: int) -> DataFrame:
    """ST5: a key's window opens at its first hit and resets once ``reset < now``;
    a hit is allowed while the window count ``n <= max``.  ``hits``: key, id, ts."""
    def step(st, r):
        now = int(r["ts"])
        if st["reset"] is None or st["reset"] < now:
            st["n"], st["reset"] = 1, now + window_ms
            allowed = True
        else:
            st["n"] += 1
            allowed = st["n"] <= max_hits
        return {"key": r["key"], "id": int(r["id"]), "ts": now, "window_start": st["reset"] - window_ms,
                "n": st["n"], "allowed": allowed}

    return ordered_fold(hits.select("key", "id", "ts"), "key", ["ts", "id"],
                        "key string, id long, ts long, window_start long, n long, allowed boolean",
                        lambda: {"n": 0, "reset": None}, step)


# ---- ST1 purchase state machine (+ conditional debits in the same ordered stream) -----

PURCHASE_SCHEMA = ("user_id long, event_id long, transaction_id string, arrival long, applied boolean, "
                   "revision long, revoked int, delta long, balance_after long, ledger_kind string, "
                   "apple_event_id string")


def _purchase_state():
    return {"balance": 0, "tx": {}}


def _purchase_step(st, r):
    src = r["source"]
    if src == "ledger":  # card/grant credit or usage debit, conditional like ST3
        amt = int(r["amount_micros"])
        if amt >= 0 or st["balance"] >= -amt:
            st["balance"] += amt
        return None
    tid, credit = r["transaction_id"], int(r["credit_micros"])
    new = 1 if r["revoked"] else 0
    signed = int(r["signed_date"])
    t = st["tx"].get(tid)
    if t is None:  # first sight: insert as undelivered (2)
        t = {"revoked": 2, "last_signed": 0, "revision": 0, "removed": 0, "credit": credit}
        st["tx"][tid] = t
    applied = t["revoked"] != new and t["last_signed"] < signed
    delta, kind, eid = 0, None, None
    if applied:
        old, bal = t["revoked"], st["balance"]
        if old == 2:
            delta = 0 if new == 1 else t["credit"]
        elif new == 1:
            delta = -min(t["credit"], bal)
        else:
            delta = t["removed"]
        removed = (t["credit"] if old == 2 else min(t["credit"], bal)) if new == 1 else 0
        t.update(revoked=new, last_signed=signed, revision=t["revision"] + 1, removed=removed)
        st["balance"] += delta
        kind = "refund" if new == 1 else "topup"
        eid = (f"purchase:{tid}" if t["revision"] == 1 and new == 0
               else f"state:{tid}:{t['revision']}")
    t["last_signed"] = max(t["last_signed"], signed)
    return {"user_id": int(r["user_id"]), "event_id": int(r["id"]), "transaction_id": tid,
            "arrival": int(r["arrival"]), "applied": applied, "revision": t["revision"],
            "revoked": t["revoked"], "delta": delta, "balance_after": st["balance"],
            "ledger_kind": kind, "apple_event_id": eid}


def purchase_states(store_events: DataFrame, ledger_events: DataFrame) -> DataFrame:
    """ST1 + ST2 + ST8 + W7: apply validated store events per user in arrival order.

    ``store_events``: user_id, id, transaction_id, credit_micros, revoked, signed_date, arrival.
    ``ledger_events``: user_id, id, amount_micros, arrival (card/grant credits, usage debits).
    Concurrent copies of one state (ST8) and stale or repeated states (ST2) are no-ops
    inside the fold: a copy finds ``revoked`` already equal, a stale one an older
    ``signedDate``; they are reported with ``applied = false``.
    """
    s = (store_events
         .select("user_id", "id", "transaction_id", "credit_micros", "revoked", "signed_date", "arrival",
                 F.lit(None).cast("long").alias("amount_micros"), F.lit("store").alias("source")))
    lgr = ledger_events.select("user_id", "id", F.lit(None).cast("string").alias("transaction_id"),
                               F.lit(None).cast("long").alias("credit_micros"),
                               F.lit(None).cast("boolean").alias("revoked"),
                               F.lit(None).cast("long").alias("signed_date"), "arrival",
                               "amount_micros", F.lit("ledger").alias("source"))
    return ordered_fold(s.unionByName(lgr), "user_id", ["arrival", "source", "id"],
                        PURCHASE_SCHEMA, _purchase_state, _purchase_step)


def store_product_credit(product_col: str = "product_id") -> F.Column:
    """Credit of a listed store product, NULL for anything else."""
    m = F.create_map(*[x for p, c in D.STORE_PRODUCTS for x in (F.lit(p), F.lit(c))])
    return m[F.col(product_col)]
