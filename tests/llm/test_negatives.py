import numpy as np
import pytest
from pyspark.sql import functions as F

from meterline.llm import negatives, queries


def plain(rows, positives=5, negatives_=5):
    """All pairs of (vec_id, label, components); null rows left out before."""
    ok = [(i, lab, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, lab, v in rows
          if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    ok = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, v) for i, lab, v in ok]
    out = []
    for a in {repr(r): r for r in ok if r[0] % 100 == 0}.values():
        met = [(-sum(x * y for x, y in zip(a[2], r[2])), r[0], r[1] == a[1]) for r in ok if r[0] != a[0]]
        for neg, pid, _ in sorted(m for m in met if m[2])[:positives]:
            fits = sorted(m for m in met if not m[2] and 80 * -neg <= 100 * -m[0] <= 100 * -neg)[:negatives_]
            out += [(a[0], pid, k, m[1], -neg, -m[0]) for k, m in enumerate(fits, 1)]
    return sorted(out)


def mined(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumn("v", F.lit("x")).withColumn(
        "anchor", F.lit(1)).withColumn("score", F.lit(0))
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    got = negatives.mine(negatives.vectors(df.repartition(5), label=label), F.col("vec_id") % 100 == 0, **kw)
    return sorted(map(tuple, got.collect()))


def some(n, seed, labels=4, dims=6, grid=None):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dims)) + 1.2
    if grid:  # few different values: many ties
        v = np.round(v * grid) / grid
    return [(int(i), int(rng.integers(labels)), [float(x) for x in v[i]]) for i in range(n)]


@pytest.mark.parametrize("seed, grid", [(1, None), (2, 2), (3, 1)])
def test_equals_all_pairs(spark, seed, grid):
    rows = some(900, seed, grid=grid)
    want = plain(rows)
    assert want and mined(spark, rows) == want


def test_groups_of_anchors_and_a_hot_copy(spark, monkeypatch):
    monkeypatch.setattr(negatives, "GROUP_BYTES", 256)  # a few anchors a pass
    monkeypatch.setattr(negatives, "BATCH", 64)
    monkeypatch.setattr(negatives, "ANCHORS", 2)
    rows = some(700, 5)
    rows += [(10_000 + i, 1, rows[3][2]) for i in range(350)]  # a third of the rows has one vector
    assert mined(spark, rows) == plain(rows)


def test_edges(spark):
    rows = some(250, 9) + [
        (None, 1, [1.0] * 6), (1000, None, [1.0] * 6), (1100, 2, None), (1200, 2, [None, 1.0]), (1300, 2, [float("nan")] * 6),
        (1400, 2, [float("inf")] * 6), (1500, 3, []), (1600, 1, [1.0, 1.0]), (1601, 2, [0.5] * 9), (1601, 2, [0.5] * 9),
        (100, 1, [1.0] * 6), (100, 1, [1.0] * 6), (1700, 0, [-1.0] * 6), (1800, 0, [0.0] * 6)]
    assert mined(spark, rows) == plain(rows)
    assert mined(spark, []) == []
    assert mined(spark, [(100, 1, [1.0])]) == []  # nothing else there
    huge = [(100, 1, [3e30]), (101, 1, [3e30]), (102, 2, [3e30]), (103, 2, [1.0])]
    assert mined(spark, huge)[0][:4] == (100, 101, 1, 102)  # held within a long, no crash


def test_slot_combiner_keeps_the_best():
    rng = np.random.default_rng(4)
    best, seen = negatives.Best(3, 2, 4), {(s, a): [] for s in range(2) for a in range(3)}
    for _ in range(40):
        s, ids, fits = rng.integers(-9, 9, (2, 30)), rng.permutation(10_000)[:30], rng.random((2, 30)) < 0.6
        slot, first = int(rng.integers(2)), int(rng.integers(2))
        best.add(slot, first, s, ids, fits)
        for r in range(2):
            seen[slot, first + r] += [(-int(x), int(i)) for x, i, f in zip(s[r], ids, fits[r]) if f]
    for (slot, a), rows in seen.items():
        want = sorted(rows)[:4]
        assert list(zip((-best.score[slot, a]).tolist(), best.id[slot, a].tolist())) == want


def test_registered(spark):
    got = queries.QUERIES["op13_hard_negatives"](spark, "/root/testdata/sf0.001")
    assert [c for c, _ in got.dtypes] == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert dict(got.dtypes)["rank"] == "int" and set(dict(got.dtypes).values()) == {"bigint", "int"}
