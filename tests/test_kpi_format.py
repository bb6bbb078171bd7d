"""KPI text helpers (V1, V2, X14-X17) against the service's display rules, and S4."""

from pyspark.sql import functions as F

from meterline.operators import kpi
from meterline.sources.derived import analytics_state, tracking_since


def ev(spark, rows, schema, expr):
    return [r.x for r in spark.createDataFrame(rows, schema).select(expr.alias("x")).collect()]


def test_ratio_and_percent(spark):
    got = ev(spark, [(1, 3), (1, 0), (0, 4)], "n long, d long", kpi.ratio(F.col("n"), F.col("d")))
    assert got[0] == 1 / 3 and got[1] is None and got[2] == 0.0
    got = ev(spark, [(1, 3), (1, 0), (2000, 1)], "n long, d long", kpi.percent_text(F.col("n"), F.col("d")))
    assert got == ["33.3%", "—", "200,000%"]


def test_change_text(spark):
    rows = [(12, 10), (8, 10), (5, 0), (0, 0), (10, 10)]
    got = ev(spark, rows, "n long, p long", kpi.change_text(F.col("n"), F.col("p")))
    assert got == ["+20% vs prior period", "−20% vs prior period", "No prior-period baseline",
                   "No change from prior period", "+0% vs prior period"]
    got = ev(spark, [(1, 2)], "n long, p long", kpi.change_text(F.col("n"), F.col("p"), False))
    assert got == ["Comparison collecting history"]


def test_duration_and_money_and_day(spark):
    got = ev(spark, [(999,), (1500,), (90000,), (5400000,), (None,)], "ms long", kpi.duration_text(F.col("ms")))
    assert got == ["999 ms", "1.5 s", "1.5 min", "1.5 hr", "—"]
    got = ev(spark, [(1_234_567,), (5_000_000,)], "m long", kpi.usd_text(F.col("m")))
    assert got == ["$1.23", "$5.00"]
    got = ev(spark, [(1_704_412_800_000,)], "t long", kpi.day_label(F.col("t")))
    assert got == ["Jan 5, 2024"]


def test_tracking_since_reads_state_or_defaults_to_now(spark):
    assert tracking_since(analytics_state(spark, 123), 999) == 123
    empty = spark.createDataFrame([], "key string, value long")
    assert tracking_since(empty, 999) == 999
