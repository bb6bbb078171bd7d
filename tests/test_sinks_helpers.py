"""Sinks (S5, S6, S9) and small helpers."""

import tempfile

from pyspark.sql import functions as F

from meterline.functions.clock import clock
from meterline.operators import engagement as eng
from meterline.operators import pricing as pr
from meterline.operators import purchases as pu
from meterline.sources import dims as D
from meterline.sources import sinks
from event_rows import make_events

END = 1_790_899_200_000


def test_append_events_keeps_only_allowed_columns(spark):
    d = tempfile.mkdtemp(prefix="meterline-sink-")
    ev = make_events(spark, [(1, "run_succeeded", "free-request", 200, 5, END)]).withColumn("prompt", F.lit("secret"))
    sinks.append_events(ev, d)
    sinks.append_events(ev, d)
    back = spark.read.parquet(d)
    assert "prompt" not in back.columns and back.count() == 2 and "day" in back.columns


def test_append_idempotent_replays_add_nothing(spark):
    d = tempfile.mkdtemp(prefix="meterline-ledger-")
    rows = spark.createDataFrame([("cs_1", 1, 5, 10), ("cs_1", 1, 5, 11), ("cs_2", 2, 7, 12)],
                                 "session_id string, user_id long, amount long, arrival long")
    assert sinks.append_idempotent(rows, d, "session_id", "arrival").count() == 2
    assert sinks.append_idempotent(rows, d, "session_id", "arrival").count() == 0
    assert spark.read.parquet(d).count() == 2


def test_append_csv(spark):
    d = tempfile.mkdtemp(prefix="meterline-csv-")
    rows = spark.createDataFrame([("Cafe", "2024-01-02", 12.5)], "merchant string, date string, total double")
    sinks.append_csv(rows, d)
    sinks.append_csv(rows, d)
    assert spark.read.schema("merchant string, date date, total double").csv(d).count() == 2


def test_retail_prices_and_products(spark):
    r = {x.model: x for x in pr.retail_prices(D.text_prices(spark)).collect()}
    assert abs(r[D.DEFAULT_MODEL].retail_in - 0.293 * 1.5) < 1e-12
    assert r[D.DEFAULT_MODEL].retail_out_text == "$3.38"
    assert [p.credit_micros for p in pr.products_by_credit(D.store_products(spark)).collect()] == \
        [5_000_000, 10_000_000, 25_000_000, 50_000_000]


def test_audio_payload_base64(spark):
    df = spark.createDataFrame([(bytearray(b"hello"),)], "b binary")
    assert df.select(pr.audio_payload(F.col("b")).alias("x")).collect()[0].x == "aGVsbG8="


def test_approx_active_users_close_to_exact(spark):
    rows = [(u, "run_succeeded", "s", 200, 1, END - 86_400_000 * (u % 5 + 1)) for u in range(2000)]
    e = make_events(spark, rows)
    c = clock(END, 7)
    approx = {r.day: r.active_approx for r in eng.approx_active_users(e, c).collect()}
    exact = {r.day: r.active for r in eng.daily_series(e, c, 0).collect() if r.active}
    assert set(approx) == set(exact)
    assert all(abs(approx[d] - exact[d]) <= 0.05 * exact[d] for d in exact)


def test_refund_backfill(spark):
    tx = spark.createDataFrame([("Production:1", 1, 5_000_000, 0), ("Production:2", 1, 5_000_000, 7),
                                ("Production:3", 0, 5_000_000, 9)],
                               "id string, revoked int, credit_micros long, removed_micros long")
    lg = spark.createDataFrame([("refund:Production:1", -2_000_000)], "apple_event_id string, amount_micros long")
    out = {r.id: r.removed_micros for r in pu.refund_backfill(tx, lg).collect()}
    assert out == {"Production:1": 2_000_000, "Production:2": 5_000_000, "Production:3": 9}
