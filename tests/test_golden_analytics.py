"""Golden cases G1-G5: the service's own analytics expectations, as data."""

from datetime import datetime, timezone

from pyspark.sql import functions as F

from event_rows import DAY, make_events
from meterline.functions.clock import clock
from meterline.operators import cohorts as coh
from meterline.operators import engagement as eng
from meterline.operators import features as feat
from meterline.operators import money

END = int(datetime(2026, 10, 2, tzinfo=timezone.utc).timestamp() * 1000)
LEDGER = ("id long, user_id long, kind string, amount_micros long, stripe_session_id string, "
          "apple_event_id string, created_at long")
STORE = "id string, user_id long, environment string"


def ev(user, age, status=200, slug="free-request", duration=100):
    name = "run_succeeded" if status == 200 else "run_failed"
    return (user, name, slug, status, duration, END - age * DAY)


def users_df(spark, pairs):
    return spark.createDataFrame([(u, END - a * DAY) for u, a in pairs], "id long, created_at long")


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()


def test_g1_engagement(spark):
    rows = [ev(1, a) for a in (9, 8, 3, 3, 1, 0, 30, 31)] + [ev(2, 8), ev(2, 1, 402), ev(3, 1, 422)]
    e = make_events(spark, rows)
    c = clock(END + 1000, 30)
    periods = {r["period"]: r.asDict() for r in eng.period_engagement(e, c).collect()}
    assert periods["current"]["runs"] == 7
    assert periods["current"]["active"] == 2
    assert periods["current"]["repeat_users"] == 1
    assert periods["current"]["attempts"] == 9
    assert periods["previous"]["runs"] == 1
    w = one(eng.weekly_repeat_users(e, c))
    assert (w["repeat_users"], w["active"], w["previous_active"], w["retained"], w["lapsed"]) == (1, 1, 2, 1, 1)
    assert one(eng.today(e, c))["runs"] == 1
    daily = eng.daily_series(e, c, END - 200 * DAY).collect()
    assert len(daily) == 30
    assert sum(1 for d in daily if d.runs == 0 and d.failures == 0) == 25


def _cohort_inputs(spark):
    us = users_df(spark, [(1, 20), (2, 20), (3, 3), (4, 10), (5, 20), (6, 40)])
    rows = [ev(1, 19), ev(1, 12), ev(2, 13), ev(3, 2), ev(4, 9), ev(5, 19, 402), ev(6, 39), ev(6, 12)]
    rows += [(1, "signup", None, None, None, END - 20 * DAY)] * 3
    e = make_events(spark, rows)
    empty_ledger = spark.createDataFrame([], LEDGER)
    empty_store = spark.createDataFrame([], STORE)
    return us, e, empty_ledger, empty_store


def test_g2_cohorts(spark):
    us, e, lg, st = _cohort_inputs(spark)
    c = clock(END, 90)
    t = one(coh.cohort_totals(coh.signup_cohorts(coh.account_lifecycle(us, e, lg, st, c, END - 200 * DAY), c)))
    assert t["signups"] == 6 and t["eligible7"] == 5 and t["activated7"] == 3
    assert t["activation_ms"] == 3 * DAY
    assert (t["eligible14"], t["retained14"], t["eligible35"], t["retained35"]) == (2, 1, 1, 1)
    recent = one(coh.cohort_totals(coh.signup_cohorts(coh.account_lifecycle(us, e, lg, st, c, END - 15 * DAY), c)))
    assert recent["signups"] == 2 and recent["activated7"] == 1


def test_g2_week_label_is_monday(spark):
    # Monday, Saturday and Sunday signups -> the Monday on or before.
    mon = int(datetime(2026, 9, 28, 13, tzinfo=timezone.utc).timestamp() * 1000)
    df = spark.createDataFrame([(mon,), (mon + 5 * DAY,), (mon + 6 * DAY,), (mon + 7 * DAY,)], "created_at long")
    weeks = [r.w for r in df.select(coh.monday_week("created_at").alias("w")).collect()]
    assert weeks == ["2026-09-28", "2026-09-28", "2026-09-28", "2026-10-05"]


def test_g3_money(spark):
    us = users_df(spark, [(1, 100), (2, 100), (3, 40), (4, 40)])
    e = make_events(spark, [ev(1, 1), ev(2, 1)])
    lg = spark.createDataFrame([
        (1, 1, "topup", 5_000_000, "cs_live_old", None, END - 40 * DAY),
        (2, 1, "topup", 5_000_000, "cs_live_new", None, END - 2 * DAY),
        (3, 2, "topup", 250_000, None, None, END - 2 * DAY),
        (4, 2, "topup", 50_000_000, "cs_test_ignore", None, END - 1 * DAY),
        (5, 2, "topup", 5_000_000, None, "purchase:Sandbox:123", END - 1 * DAY),
        (6, 3, "topup", 10_000_000, None, "purchase:Production:456", END - 20 * DAY),
        (7, 4, "topup", 5_000_000, "cs_live_day30", None, END - 10 * DAY)], LEDGER)
    st = spark.createDataFrame([("Sandbox:123", 2, "Sandbox"), ("Production:456", 3, "Production")], STORE)
    c90 = clock(END, 90)
    m = one(money.money_summary(us, e, lg, st, c90))
    assert m["purchased"] == 25_000_000 and m["granted"] == 250_000 and m["active_payers"] == 1
    t = one(coh.cohort_totals(coh.signup_cohorts(coh.account_lifecycle(us, e, lg, st, c90, END - 200 * DAY), c90)))
    assert t["paid30"] == 1
    m30 = one(money.money_summary(us, e, lg, st, clock(END, 30)))
    assert (m30["purchased"], m30["buyers"], m30["first_buyers"], m30["previous_purchased"]) == \
        (20_000_000, 3, 2, 5_000_000)


def test_g4_features_p95(spark):
    rows = [ev(1, 1, 200, "free-request", i * 100) for i in range(1, 21)]
    rows += [ev(1, 2, 402, "free-request", 99999), ev(1, 3, 422, "field-finder", 1000)]
    f = feat.feature_table(make_events(spark, rows), clock(END, 30)).collect()
    assert f[0].slug == "free-request" and f[0].p95_ms == 1900 and f[0].repeat_users == 0
    assert f[0].users == 1 and f[0].credit_blocks == 1
    assert f[1].slug == "field-finder" and f[1].p95_ms is None


def test_g5_empty(spark):
    e = spark.createDataFrame([], "id long, event_name string, user_id long, slug string, status int, "
                                  "duration_ms long, source string, created_at long")
    c = clock(END, 7)
    daily = eng.daily_series(e, c, END).collect()
    assert len(daily) == 7 and all(d.runs == 0 and d.active == 0 for d in daily)
    assert {r.period: (r.attempts, r.runs) for r in eng.period_engagement(e, c).collect()} == \
        {"current": (0, 0), "previous": (0, 0)}
    t = one(eng.today(e, c))
    assert (t["attempts"], t["runs"], t["active"], t["last_event"]) == (0, 0, 0, None)
    assert one(eng.weekly_repeat_users(e, c))["active"] == 0


def test_invalid_days_fall_back_to_30():
    assert clock(END, 45).days == 30 and clock(END, "7").days == 7 and clock(END, None).days == 30


def test_p95_matches_brute_force(spark):
    import random
    rnd = random.Random(7)
    rows, by_slug = [], {}
    for i in range(2000):
        s = f"s{rnd.randrange(5)}"
        d = rnd.choice([None, rnd.randrange(0, 300)])
        rows.append((1, "run_succeeded", s, 200, d, END - DAY))
        if d is not None:
            by_slug.setdefault(s, []).append(d)
    got = {r.slug: r.p95_ms for r in feat.feature_p95(make_events(spark, rows), clock(END, 30)).collect()}
    for s, v in by_slug.items():
        v = sorted(v)
        assert got[s] == v[(95 * len(v) + 99) // 100 - 1]
