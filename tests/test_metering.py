import random

import pytest

from meterline.operators import metering

RUNS = "id long, user_id long, at long, reserved_micros long, actual_micros long, settled_at long"
CREDITS = "user_id long, at long, id long, amount_micros long"


def plain(runs, credits, opening):
    rows = [(u, -(1 << 62), 0, -1, b, None) for u, b in opening]
    rows += [(u, at, 0, i, a, None) for u, at, i, a in credits]
    for i, u, at, reserved, actual, done in runs:
        actual = min(actual, reserved)
        rows.append((u, at, 2, i, reserved, actual))
        if done is not None:
            rows.append((u, done, 1, i, reserved - actual, actual))
    balance, held, out = {}, set(), []
    for u, at, step, i, amount, actual in sorted(rows, key=lambda r: r[:4]):
        b, ok = balance.get(u, 0), None
        if step == 2:
            ok = b >= amount
            amount = -amount if ok else 0
            if ok:
                held.add(i)
        elif step == 1:
            ok = i in held
            amount = amount if ok else 0
        balance[u] = b + amount
        out.append((u, at, step, i, ok, amount, actual if step == 1 and ok else None, balance[u]))
    return sorted(out)


def made(spark, runs, credits, opening):
    return metering.metered_runs(spark.createDataFrame(runs, RUNS).repartition(4), spark.createDataFrame(credits, CREDITS),
                                 spark.createDataFrame(opening, "user_id long, balance_micros long"))


def some(seed, n=500, users=6, rich=60):
    rng = random.Random(seed)
    runs, credits = [], []
    for i in range(n):
        u, at = rng.choice([0, 0, *range(users)]), rng.randrange(3000)
        if rng.random() < 0.2:
            credits.append((u, at, i, rng.randrange(rich)))
        else:
            reserved = rng.randrange(30)
            runs.append((i, u, at, reserved, rng.randrange(40), None if rng.random() < 0.1 else at + rng.randrange(1, 400)))
    return runs, credits, [(u, rng.randrange(50)) for u in range(users)]


@pytest.mark.parametrize("seed, rich", [(1, 20), (2, 60), (3, 120), (4, 400)])
def test_equals_the_walk(spark, seed, rich):
    data = some(seed, rich=rich)
    want = plain(*data)
    assert sorted(map(tuple, made(spark, *data).collect())) == want
    assert {r[4] for r in want} == {True, False, None}


def test_only_doubtful_reservations_are_folded(spark, monkeypatch):
    seen = []
    fold = metering._fold
    monkeypatch.setattr(metering, "_fold", lambda rows: seen.append(rows.where("step = 2").count()) or fold(rows))
    runs = [(i, 1, 10 + 2 * i, 10, 4, 11 + 2 * i) for i in range(400)]
    assert all(r.accepted for r in made(spark, runs, [(1, 1, 9999, 100_000)], [(1, 0)]).where("step = 2").collect())
    assert not any(r.accepted for r in made(spark, runs, [], [(1, 5)]).where("step = 2").collect())
    assert seen == [0, 0]


def test_ledger_and_open_reservations_add_up(spark):
    moved = made(spark, *some(7)).cache()
    booked = {r[0]: r[1] for r in metering.ledger_rows(moved).groupBy("user_id").sum("amount_micros").collect()}
    held = {r[0]: r[1] for r in metering.open_reservations(moved).collect()}
    last = {}
    for r in sorted(moved.collect(), key=lambda r: (r.user_id, r.at, r.step, r.id)):
        last[r.user_id] = r.balance_micros
        assert r.balance_micros >= 0
    assert last == {u: booked.get(u, 0) - held.get(u, 0) for u in last} and held


def test_empty(spark):
    assert made(spark, [], [], []).collect() == []
    assert [tuple(r) for r in made(spark, [], [], [(3, 7)]).collect()] == [(3, -(1 << 62), 0, -1, None, 7, None, 7)]
