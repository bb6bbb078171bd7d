import random

import pytest

from meterline.functions import idfilter
from meterline.functions.idfilter import IdFilter
from meterline.operators import privacy, reconcile


def test_lists_exactly_the_planted_differences(spark):
    rng = random.Random(1)
    amounts = {i: rng.randrange(-50, 50) or 1 for i in range(5000)}
    stored = {**amounts, 17: amounts[17] + 1, 400: amounts[400] - 9, 9999: 4}
    del stored[2500]
    left, right = (spark.createDataFrame(list(d.items()), "key long, amount long").repartition(3) for d in (amounts, stored))
    want = sorted([(17, amounts[17], stored[17]), (400, amounts[400], stored[400]), (2500, amounts[2500], None), (9999, None, 4)])
    for levels in ((4,), (16, 256), (1,)):
        assert sorted(map(tuple, reconcile.differing(left, right, levels).collect())) == want
    assert reconcile.differing(left, left).collect() == []
    swapped = right.replace([amounts[1]], [amounts[2]], "amount") if amounts[1] != amounts[2] else right
    assert reconcile.differing(right, swapped).count() == swapped.exceptAll(right).count()


def test_balances_with_open_reservations(spark):
    ledger = spark.createDataFrame([(1, 100), (1, -40), (2, 10), (3, 5), (3, -5), (None, 3), (6, 8)], "user_id long, amount_micros long")
    stored = spark.createDataFrame([(1, 50), (2, 10), (4, 0), (5, 7)], "user_id long, balance_micros long")
    held = spark.createDataFrame([(1, 10)], "user_id long, open_micros long")
    got = {r.user_id: tuple(r)[1:] for r in reconcile.balance_differences(ledger, stored, held).collect()}
    assert got == {5: (None, 7, 7, "no_ledger"), 6: (8, None, -8, "not_stored")}
    assert {r.user_id for r in reconcile.balance_differences(ledger, stored).collect()} == {1, 5, 6}


def test_filter_splits_without_losing_a_row(spark):
    ids = spark.createDataFrame([(i * 7,) for i in range(300)], "id long")
    rows = spark.createDataFrame([(i if i % 5 else None, i) for i in range(4000)], "user_id long, x long")
    out, doubtful = IdFilter(ids, "id").split(rows, "user_id")
    sure = {r.user_id for r in out.collect()}
    assert None in sure and not sure & {i * 7 for i in range(300)}
    assert out.count() + doubtful.count() == 4000 and doubtful.count() < 700
    none, some = IdFilter(ids.limit(0), "id").split(rows, "user_id")
    assert none.count() == 4000 and some.count() == 0


@pytest.mark.parametrize("few", [500_000, 0])
def test_erase_equals_plain_removal(spark, monkeypatch, few):
    monkeypatch.setattr(idfilter, "FEW", few)
    rows = [(i, i % 40 if i % 11 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, user_id long")
    users = spark.createDataFrame([(i,) for i in range(40)], "id long")
    gone = spark.createDataFrame([(3,), (3,), (39,), (None,), (77,)], "user_id long")
    out = privacy.erase({"users": users, "ledger": df, "store_transactions": df}, gone)
    assert sorted(r.id for r in out["users"].collect()) == [i for i in range(40) if i not in (3, 39)]
    key = lambda r: r[0]
    assert sorted(map(tuple, out["ledger"].collect()), key=key) == [r for r in rows if r[1] not in (3, 39)]
    assert sorted(map(tuple, out["store_transactions"].collect()), key=key) == [(i, None if u in (3, 39) else u) for i, u in rows]
