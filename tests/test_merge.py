import os
import random

from meterline.sources import merge

DELTA = "event_id long, user_id long, amount_micros long"


def test_batches_and_replays(spark, tmp_path):
    rng = random.Random(3)
    path, opening = f"{tmp_path}/t", {u: 100 * u for u in range(50)}
    merge.create(spark.createDataFrame(list(opening.items()), "user_id long, balance_micros long"), path, 8)
    events = [(i, rng.randrange(60), rng.randrange(-20, 50)) for i in range(400)]
    want = dict(opening)
    for _, u, a in events:
        want[u] = want.get(u, 0) + a
    first, second = spark.createDataFrame(events[:250] * 2, DELTA), spark.createDataFrame(events[200:] + [(None, 1, 5), (999, None, 5)], DELTA)
    assert merge.merge(spark, path, first, 8) == 8
    merge.merge(spark, path, second, 8)
    assert merge.merge(spark, path, first.union(second), 8) == 0
    assert {r.user_id: r.balance_micros for r in merge.balances(spark, path).collect()} == want


def test_only_touched_folders_are_replaced_and_a_broken_merge_is_mended(spark, tmp_path):
    path = f"{tmp_path}/t"
    merge.create(spark.createDataFrame([(u, 0) for u in range(40)], "user_id long, balance_micros long"), path, 8)
    files = lambda: {d: sorted(os.listdir(f"{path}/{d}")) for d in os.listdir(path) if d.startswith("bucket=")}
    before = files()
    batch = spark.createDataFrame([(1, 7, 5), (2, 8, 6), (3, 9, 7)], DELTA)
    n = merge.merge(spark, path, batch.where("event_id = 1"), 8)  # as if the merge had ended after one folder
    after = files()
    assert n == 1 and sum(before[d] != after[d] for d in before) == 1
    merge.merge(spark, path, batch, 8)
    got = {r.user_id: r.balance_micros for r in merge.balances(spark, path).collect()}
    assert (got[7], got[8], got[9], sum(got.values())) == (5, 6, 7, 18) and len(got) == 40
