"""Golden cases G6-G10: purchase state machine, rejects, checkout, settlement, pricing."""

from pyspark.sql import functions as F

from meterline.operators import folds, ledger as lg, pricing as pr, purchases as pu
from meterline.sources import dims as D
from meterline.sources.derived import account_token

STORE = ("user_id long, id long, transaction_id string, credit_micros long, revoked boolean, "
         "signed_date long, arrival long")
LEDGER_EV = "user_id long, id long, amount_micros long, arrival long"
TX = "Production:123456789"


def run_fold(spark, store_rows, ledger_rows=()):
    s = spark.createDataFrame([(1, i, TX, 5_000_000, rev, sig, arr) for i, (rev, sig, arr) in enumerate(store_rows)],
                              STORE)
    lgr = spark.createDataFrame([(1, 1000 + i, a, arr) for i, (a, arr) in enumerate(ledger_rows)], LEDGER_EV)
    out = folds.purchase_states(s, lgr).orderBy("arrival", "event_id").collect()
    return out, (out[-1].balance_after if out else 0)


def test_g6_replays_add_nothing(spark):
    out, bal = run_fold(spark, [(False, 1000, 1), (False, 1000, 2), (False, 1000, 3), (False, 1000, 4)])
    assert bal == 5_000_000
    assert [r.applied for r in out] == [True, False, False, False]
    assert out[0].apple_event_id == f"purchase:{TX}" and out[0].revision == 1


def test_g6_refund_removes_only_available_credit(spark):
    out, bal = run_fold(spark, [(False, 1000, 1), (True, 1001, 10), (True, 1001, 11), (False, 1000, 12)],
                        ledger_rows=[(-3_000_000, 5)])
    assert bal == 0
    refund = out[1]
    assert refund.applied and refund.delta == -2_000_000 and refund.ledger_kind == "refund"
    assert not out[2].applied and not out[3].applied


def test_g6_reversal_restores_only_removed_once(spark):
    seq = [(False, 1000, 1),            # purchase: 5.0
           (True, 2000, 10),            # refund at 1.2 -> 0
           (False, 3000, 20), (False, 3000, 21),  # reversal (+ concurrent copy) -> 1.2
           (True, 2500, 30),            # stale refund ignored
           (True, 4000, 40),            # refund -> 0
           (False, 3500, 50),           # stale reversal ignored
           (False, 5000, 60), (False, 5000, 61)]  # reversal -> 1.2
    out, bal = run_fold(spark, seq, ledger_rows=[(-3_800_000, 5)])
    balances = [r.balance_after for r in out]
    assert balances == [5_000_000, 0, 1_200_000, 1_200_000, 1_200_000, 0, 0, 1_200_000, 1_200_000]
    assert bal == 1_200_000
    assert [r.revision for r in out if r.applied] == [1, 2, 3, 4, 5]
    assert out[2].apple_event_id == f"state:{TX}:3"


def test_g6_refund_before_delivery_then_reversal(spark):
    out, bal = run_fold(spark, [(True, 1000, 1), (False, 1001, 2), (False, 1000, 3)])
    assert out[0].applied and out[0].delta == 0 and out[0].ledger_kind == "refund"
    assert out[1].applied and out[1].delta == 5_000_000 and out[1].apple_event_id.startswith("state:")
    assert not out[2].applied
    assert bal == 5_000_000


def test_g7_purchase_rejects(spark):
    base = dict(id=1, user_id=1, transaction_id="123456789", seq=0, bundle_id=D.BUNDLE_ID, type="Consumable",
                ownership="PURCHASED", quantity=1, product_id="com.example.credits5",
                environment="Production", revoked=False, signed_date=1000, arrival=1)
    overrides = [dict(product_id="unknown"), dict(quantity=2), dict(ownership="FAMILY_SHARED"),
                 dict(bundle_id="another.app"), dict(environment="Sandbox"), dict(environment="Xcode"),
                 dict(type="Non-Consumable"), dict(app_account_token=None), dict(transaction_id="bad/id"),
                 dict(transaction_id="123\n"), {}]
    rows = []
    for i, o in enumerate(overrides):
        r = dict(base, id=i, app_account_token="TOKEN")
        r.update(o)
        rows.append(r)
    feed = spark.createDataFrame(rows).withColumn(
        "app_account_token", F.when(F.col("app_account_token") == "TOKEN", F.upper(account_token(F.col("user_id"))))
        .otherwise(F.col("app_account_token")))
    users = spark.createDataFrame([(1,), (4,)], "id long")
    got = {r.id: r.reject_reason for r in pu.purchase_validation(feed, users).collect()}
    assert all(got[i] is not None for i in range(10))
    assert got[10] is None
    # allow-listed sandbox account is accepted
    sb = feed.where(F.col("id") == 4).withColumn("user_id", F.lit(4).cast("long")).withColumn(
        "app_account_token", account_token(F.lit(4)))
    assert pu.purchase_validation(sb, users).collect()[0].reject_reason is None


def test_g8_checkout_rejects_malformed_and_replays(spark):
    vals = ["0", "-1", "1.5", "Infinity", "9007199254740992", "not-a-number", "1e6", "5000000"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r.x for r in df.select(lg.safe_positive_int(F.col("v")).alias("x")).collect()]
    assert got == [None, None, None, None, None, None, 1_000_000, 5_000_000]
    feed = spark.createDataFrame([
        ("cs_1", "checkout.session.completed", "paid", "1", "5000000", 10, 0),
        ("cs_1", "checkout.session.completed", "paid", "1", "5000000", 20, 1),   # duplicate delivery
        ("cs_2", "checkout.session.completed", "paid", "9", "5000000", 30, 0),   # deleted account
        ("cs_3", "checkout.session.completed", "paid", "1", "5000000", 40, 0),   # already in ledger
        ("cs_4", "checkout.session.completed", "unpaid", "1", "5000000", 50, 0)],
        "session_id string, type string, payment_status string, meta_user_id string, meta_credit string, "
        "arrival long, delivery int")
    existing = spark.createDataFrame([("cs_3",)], "stripe_session_id string")
    users = spark.createDataFrame([(1,)], "id long")
    out = {(r.session_id, r.delivery): (r.outcome, r.credited_micros)
           for r in lg.checkout_fulfilment(feed, existing, users).collect()}
    assert out[("cs_1", 0)] == ("credited", 5_000_000)
    assert out[("cs_1", 1)] == ("replay", None)
    assert out[("cs_2", 0)][0] == "unknown_account"
    assert out[("cs_3", 0)][0] == "replay"
    assert out[("cs_4", 0)][0] == "not_paid"


def test_g9_conditional_debits_and_settlement(spark):
    ev = spark.createDataFrame([(1, 1, 1, 5_000_000), (2, 1, 2, -1000), (3, 1, 3, -6_000_000), (4, 1, 4, -400)],
                               "id long, user_id long, created_at long, amount_micros long")
    out = folds.conditional_debits(ev).orderBy("id").collect()
    assert [r.accepted for r in out] == [True, True, False, True]
    assert out[-1].balance_after == 5_000_000 - 1000 - 400


def _usage(spark, rows):
    schema = ("id long, user_id long, kind string, model string, requested_max_tokens double, body_chars long, "
              "images int, input_tokens long, output_tokens long, response_chars long, audio_bytes long, "
              "audio_seconds long, provider_error string")
    return spark.createDataFrame(rows, schema)


def test_g10_pricing(spark):
    u = _usage(spark, [
        (1, 1, "text", D.DEFAULT_MODEL, None, 10, 0, 1000, 200, 0, 0, None, None),
        (2, 1, "text", "@cf/meta/llama-3.1-8b-instruct-fp8-fast", None, 10, 0, 1000, 200, 0, 0, None, None),
        (3, 1, "audio", D.AUDIO_MODEL, None, 0, 0, None, None, 0, 100, 120, None),
        (4, 1, "classifier", D.CLASSIFIER_MODEL, None, 10, 0, 1000, None, 0, 0, None, None),
        (5, 1, "image", D.IMAGE_MODEL, None, 10, 0, 14, 196, 0, 0, None, None),
        (6, 1, "text", "unknown/model", None, 10, 0, 1000, 200, 0, 0, None, None)])
    got = {r.id: r.cost_micros for r in pr.usage_cost(u, D.text_prices(spark)).collect()}
    assert (got[1], got[2], got[3], got[4], got[5]) == (1116, 183, 1530, 63, 8925)
    assert got[6] == got[1]  # unknown model priced as the default model


def test_settlement_caps_actual_at_reserved(spark):
    u = _usage(spark, [(1, 1, "text", D.DEFAULT_MODEL, 10.0, 4, 0, 100000, 100000, 0, 0, None, None),
                       (2, 1, "text", D.DEFAULT_MODEL, None, 300000, 0, 1, 1, 0, 0, None, None),
                       (3, 1, "text", D.DEFAULT_MODEL, None, 100, 0, 10, 10, 0, 0, None, "AiError: 3040: busy")])
    s = {r.id: r for r in pr.settlement(u, D.text_prices(spark)).collect()}
    assert s[1].actual_micros == s[1].reserved_micros and s[1].refund_micros == 0
    assert s[2].status == 413 and s[2].reserved_micros is None
    assert s[3].status == 429 and s[3].actual_micros == 0 and s[3].ledger_amount is None


def test_max_tokens_clamp(spark):
    df = spark.createDataFrame([(None,), (-5.0,), (0.0,), (9000.0,), (100.0,), (float("nan"),), (float("inf"),)],
                               "r double")
    got = [r.m for r in df.select(pr.clamp_max_tokens(F.col("r")).alias("m")).collect()]
    assert got == [1024.0, 1024.0, 1024.0, 4096.0, 100.0, 1024.0, 1024.0]
