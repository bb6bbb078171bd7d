"""Privacy and account maintenance.

Erasure lists and registries can be data-sized, so they are joined with plain
(semi/anti) joins and AQE decides at runtime whether a side is small enough to
broadcast -- a measured size bound, not an assumed one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.functions.idfilter import IdFilter
from meterline.functions.sequence import global_sequence


def erase(tables: dict[str, DataFrame], erasure_ids: DataFrame) -> dict[str, DataFrame]:
    """Remove the erased accounts' events, keys, sessions, identities and ledger rows
    and the accounts themselves; keep store transactions with ``user_id`` set to NULL;
    the ID registry is never touched.

    ``tables``: users(id), events/api_keys/sessions/identities/ledger(user_id),
    store_transactions(user_id), registry(id).  ``erasure_ids``: user_id.

    A short list goes out to all tasks. For a long one a Bloom filter of the erased ids splits each table first: rows that it does not
    know (and rows without an id) pass without a shuffle, only the others meet the list in an exact join.
    """
    gone = IdFilter(erasure_ids.select("user_id").where("user_id is not null").distinct(), "user_id")
    out = dict(tables)
    for name in ("users", "events", "api_keys", "sessions", "identities", "ledger"):
        if name in tables:
            out[name] = gone.without(tables[name], "id" if name == "users" else "user_id")
    if "store_transactions" in tables:
        out["store_transactions"] = gone.cleared(tables["store_transactions"], "user_id")
    return out


def orphans(children: dict[str, DataFrame], users: DataFrame) -> DataFrame:
    """Rows whose ``user_id`` has no account (``PRAGMA foreign_key_check``), per table."""
    ids = users.select(F.col("id").alias("user_id"))
    parts = [df.where(F.col("user_id").isNotNull()).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
             .join(ids, "user_id", "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("orphans")).withColumn("table", F.lit(name))
             for name, df in children.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("table", F.col("orphans").cast("long"))


def registry_seed(users: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """O1: ``INSERT INTO account_ids SELECT id FROM users`` (idempotent extend)."""
    ids = users.select("id")
    return ids.distinct() if registry is None else registry.select("id").unionByName(ids).distinct()


def high_water_mark(registry: DataFrame) -> DataFrame:
    """``COALESCE(MAX(id), 0) + 1`` over the permanent registry (1 row)."""
    return registry.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).cast("long").alias("next_id"))


def id_allocation(signups: DataFrame, registry: DataFrame, order: list[str]) -> DataFrame:
    """O2: consecutive new ids above the registry's high-water mark, in arrival order.

    ``signups`` must already be deduplicated by email (first wins).  Numbering uses
    ``global_sequence`` (no single-partition window); the high-water mark is a
    1-row aggregate crossed in.
    """
    hwm = high_water_mark(registry)
    seq = global_sequence(signups, order, "_seq", start=0)
    return seq.crossJoin(F.broadcast(hwm)).withColumn("id", F.col("next_id") + F.col("_seq")) \
        .drop("_seq", "next_id")


def id_reuse_violations(new_ids: DataFrame, registry_before: DataFrame,
                        registry_after: DataFrame) -> DataFrame:
    """O3: ids handed out again (already registered) and registered ids that vanished."""
    reused = new_ids.select("id").join(registry_before.select("id"), "id", "left_semi") \
        .withColumn("violation", F.lit("reused"))
    removed = registry_before.select("id").join(registry_after.select("id"), "id", "left_anti") \
        .withColumn("violation", F.lit("removed"))
    return reused.unionByName(removed)


def consent_update(accounts: DataFrame, consent_events: DataFrame) -> DataFrame:
    """The latest consent choice per account sets version 1 + time, or clears both."""
    latest = (consent_events.groupBy("user_id")
              .agg(F.max_by(F.struct("allowed", "created_at"), F.struct("created_at", "id")).alias("c")))
    j = accounts.join(latest, accounts["id"] == latest["user_id"], "left").drop("user_id")
    has = F.col("c").isNotNull()
    return j.select(*[c for c in accounts.columns if c not in ("ai_consent_version", "ai_consent_at")],
                    F.when(has, F.when(F.col("c.allowed"), 1).otherwise(0))
                    .otherwise(accounts["ai_consent_version"]).alias("ai_consent_version"),
                    F.when(has, F.when(F.col("c.allowed"), F.col("c.created_at")))
                    .otherwise(accounts["ai_consent_at"]).alias("ai_consent_at"))


def consented_events(events: DataFrame, accounts: DataFrame, version: int = 1) -> DataFrame:
    """keep rows of accounts whose consent version is current."""
    ok = accounts.where(F.col("ai_consent_version") == version).select(F.col("id").alias("user_id"))
    return events.join(ok, "user_id", "left_semi")


def erasure_counts(tables: dict[str, DataFrame], erasure_ids: DataFrame,
                   kept: tuple[str, ...] = ("store_transactions", "registry")) -> DataFrame:
    """O6 summary in one pass per table: rows before, rows after and rows still linked to
    an account, from a flagged left join with the erasure list (no before/after re-scan).
    ``kept`` tables keep every row (transactions lose only their link; the registry
    keeps everything)."""
    gone = erasure_ids.select("user_id").distinct().withColumn("_erased", F.lit(True))
    parts = []
    for name, df in tables.items():
        key = "id" if name in ("users", "registry") else "user_id"
        # counted per account before the join: only the key column is read, and rows without an account are one row a task
        f = df.groupBy(F.col(key).alias("user_id")).agg(F.count(F.lit(1)).alias("n")).join(gone, "user_id", "left")
        erased = F.lit(False) if name == "registry" else F.coalesce(F.col("_erased"), F.lit(False))
        after = F.lit(True) if name in kept else ~erased

        def total(cond):
            return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))

        parts.append(f.agg(total(F.lit(True)).alias("rows_before"), total(after).alias("rows_after"),
                           total(~erased & F.col("user_id").isNotNull()).alias("linked_after"))
                     .withColumn("table_name", F.lit(name)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("table_name", *[F.col(c).cast("long").alias(c)
                                      for c in ("rows_before", "rows_after", "linked_after")])
