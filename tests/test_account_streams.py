import random

from meterline.operators import folds
from meterline.streaming import accounts

STORE = "user_id long, id long, transaction_id string, credit_micros long, revoked boolean, signed_date long, arrival long"
LEDGER = "user_id long, id long, amount_micros long, arrival long"
TX = "user_id long, transaction_id string, " + accounts.TX_SCHEMA


def streams(spark, path, parts, schema):
    """A stream that reads each part as a micro-batch of its own."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/p{i}")
    import glob
    import os
    import shutil
    os.makedirs(f"{path}/all", exist_ok=True)
    for i in range(len(parts)):
        for f in glob.glob(f"{path}/p{i}/*.parquet"):
            target = f"{path}/all/part-{i}.parquet"
            shutil.copyfile(f, target)
            os.utime(target, (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/all")


def feed(seed, n=120):
    rng = random.Random(seed)
    store, ledger = [], []
    for i in range(n):
        t, u = i * 10, rng.randrange(4)
        if rng.random() < 0.3:
            ledger.append((u, 1000 + i, rng.randrange(-40, 60), t))
        else:
            store.append((u, i, f"Production:{u}{rng.randrange(3)}", 50, rng.random() < 0.4, t + rng.randrange(-30, 30), t))
    return store, ledger


def test_purchases_in_three_batches_equal_one_fold(spark, tmp_path):
    store, ledger = feed(1)
    want = folds.purchase_states(spark.createDataFrame(store, STORE), spark.createDataFrame(ledger, LEDGER)).collect()
    cut = [0, 400, 800, 1200]
    parts = lambda rows, at: [[r for r in rows if a <= r[at] < b] for a, b in zip(cut, cut[1:])]
    none = spark.createDataFrame([], "user_id long, balance_micros long"), spark.createDataFrame([], TX)
    got = accounts.purchase_stream(spark, streams(spark, f"{tmp_path}/s", parts(store, 6), STORE),
                                   streams(spark, f"{tmp_path}/l", parts(ledger, 3), LEDGER), *none).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr) and len(want) == len(store)


def test_opening_balances_existing_transactions_and_tombstones(spark, tmp_path):
    store = [(1, 1, "P:known", 50, True, 20, 10),       # known and granted: a refund takes what the balance holds
             (1, 2, "P:gone", 50, False, 20, 11),       # its account was deleted
             (2, 3, "P:known", 50, False, 30, 12),      # belongs to account 1
             (2, 4, "P:new", 50, False, 30, 13), (1, 5, "P:new", 50, False, 30, 14),  # the first account keeps it
             (1, 6, "P:known", 50, False, 40, 15)]      # reversal: what was removed comes back
    existing = [(1, "P:known", 0, 10, 1, 0, 50), (None, "P:gone", 0, 10, 1, 0, 50)]
    got = accounts.purchase_stream(
        spark, streams(spark, f"{tmp_path}/s", [store], STORE), streams(spark, f"{tmp_path}/l", [[(9, 99, 1, 1)]], LEDGER),
        spark.createDataFrame([(1, 30)], "user_id long, balance_micros long"), spark.createDataFrame(existing, TX)).collect()
    rows = {r.event_id: (r.applied, r.delta, r.balance_after, r.revision) for r in got}
    assert rows == {1: (True, -30, 0, 2), 6: (True, 30, 30, 3), 4: (True, 50, 50, 1)}


def test_expired_sessions_are_purged_once(spark, tmp_path):
    schema = "token_hash string, user_id long, created_at long, expires_at long"
    parts = [[("a", 1, 500, 5000), ("b", 2, 1000, 9000), ("d", 4, 1000, 20_000)], [("b", 2, 6000, 30_000), ("c", 3, 7000, 8000)],
             [("e", 5, 20_000, 90_000)]]
    got = accounts.expired_sessions(spark, streams(spark, str(tmp_path), parts, schema)).collect()
    assert sorted(map(tuple, got)) == [("a", 1, 5000), ("c", 3, 8000)]  # d expires at the latest event time, not before it


def test_sessions_of_a_share_end_one_by_one(spark, tmp_path):
    schema = "token_hash string, user_id long, created_at long, expires_at long"
    many = [(f"s{i}", i, 1000, 5000 + i) for i in range(300)]
    parts = [many + [("null user", None, 1000, 6000), ("no end", 7, 1000, None), ("same end", 8, 1000, 5001), ("same end", 9, 1000, 5001)],
             [("s5", 77, 2000, 5005), ("s6", 78, 2000, 9000), ("t", 1, 5100, 50_000)], [("u", 1, 5200, 5201), ("v", 1, 5250, 60_000)]]
    got = accounts.expired_sessions(spark, streams(spark, str(tmp_path), parts, schema), shards=3).collect()
    want = [(f"s{i}", i, 5000 + i) for i in range(250) if i != 6] + [("same end", 9, 5001), ("u", 1, 5201)]
    assert sorted(map(tuple, got)) == sorted(want)  # s249 ends one ms before the latest event time, s250 at it
