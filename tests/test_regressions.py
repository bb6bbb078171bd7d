"""Cases that the fixture tables do not hold: layouts, late and replayed events, missing fields, ties."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from meterline.functions.sequence import global_sequence
from meterline.operators import identity, kpi, ledger, purchases, textprep
from meterline.sources import dims as D
from meterline.sources import sinks
from meterline.sources.derived import Model, account_token, base_events_from, checkout_feed
from meterline.streaming import jobs

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


@pytest.mark.parametrize("reuse", ["true", "false"])
def test_global_sequence_keeps_every_row(spark, tmp_path, reuse):
    n = 300_000
    spark.range(n).select((F.col("id") * 7919 % n).alias("k")).repartition(5).write.parquet(str(tmp_path / "k"))
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    try:
        got = global_sequence(spark.read.parquet(str(tmp_path / "k")), ["k"])
        row = got.agg(F.count("*"), F.countDistinct("seq"), F.min("seq"), F.max("seq"),
                      F.count_if(F.col("seq") != F.col("k") + 1)).first()
    finally:
        spark.conf.set("spark.sql.exchange.reuse", "true")
    assert tuple(row) == (n, n, 1, n, 0)


@pytest.fixture(scope="module")
def split_events(spark, tmp_path_factory):
    """The events table as a folder of four part files, newest events first."""
    root = tmp_path_factory.mktemp("split")
    ev = spark.read.parquet(f"{SF}/events.parquet").toPandas().sort_values("ts", ascending=False)
    os.makedirs(root / "events.parquet")
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    step = -(-len(ev) // 4)
    for i in range(4):
        part = root / f"p{i}"
        spark.createDataFrame(ev.iloc[i * step:(i + 1) * step], schema).coalesce(1).write.parquet(str(part))
        name = next(f for f in os.listdir(part) if f.startswith("part-") and f.endswith(".parquet"))
        target = root / "events.parquet" / f"part-{i}.parquet"
        os.rename(part / name, target)
        os.utime(target, (1_700_000_000 + i, 1_700_000_000 + i))
    return str(root)


@needs_data
def test_streams_read_folders_and_count_late_events(spark, split_events):
    whole = {tuple(r) for r in jobs.daily_counts(spark, SF).collect()}
    late = {tuple(r) for r in jobs.daily_counts(spark, split_events, max_files=1).collect()}
    assert whole and whole == late
    rows = spark.read.parquet(jobs.ingest_events(spark, SF)).count()
    assert rows > 0 and spark.read.parquet(jobs.ingest_events(spark, split_events)).count() == rows


@needs_data
def test_checkout_stream_credits_the_same_sessions_in_any_order(spark, split_events):
    m = Model(spark, SF)
    none = spark.createDataFrame([], "session_id string")
    whole = {r.session_id for r in jobs.checkout_stream(spark, SF, m.users, none).collect()}
    late = [r.session_id for r in jobs.checkout_stream(spark, split_events, m.users, none, max_files=1).collect()]
    feed = checkout_feed(base_events_from(spark.read.parquet(f"{SF}/events.parquet")))
    batch = {r.session_id for r in ledger.checkout_fulfilment(
        feed, spark.createDataFrame([], "stripe_session_id string"), m.users).where("outcome = 'credited'").collect()}
    assert whole == batch and sorted(late) == sorted(batch)


def test_append_idempotent_returns_what_it_wrote(spark, tmp_path):
    path = str(tmp_path / "ledger")
    schema = "ext string, at long, amount long"
    first = spark.createDataFrame([("a", 1, 10), ("a", 2, 99), ("b", 1, 20), (None, 1, 5), (None, 2, 6)], schema)
    new = sinks.append_idempotent(first, path, "ext", "at")
    assert sorted(map(str, new.collect())) == sorted(map(str, spark.read.parquet(path).collect())) and new.count() == 4
    spark.catalog.clearCache()
    assert new.count() == 4  # still what was appended, whatever the target holds now
    again = sinks.append_idempotent(spark.createDataFrame([("b", 9, 1), ("c", 9, 1)], schema), path, "ext", "at")
    assert [r.ext for r in again.collect()] == ["c"] and spark.read.parquet(path).count() == 5


def test_a_store_that_cannot_be_read_is_an_error(spark, tmp_path):
    bad = tmp_path / "ledger"
    bad.mkdir()
    (bad / "part-0.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception):
        sinks.append_idempotent(spark.createDataFrame([("a", 1)], "ext string, at long"), str(bad), "ext", "at")


def test_missing_purchase_fields_are_refused(spark):
    users = spark.createDataFrame([(1,)], "id long")
    token = users.select(account_token(F.col("id"))).first()[0]
    good = {"id": 0, "user_id": 1, "transaction_id": "12", "seq": 1, "environment": "Production", "revoked": False,
            "signed_date": 5, "arrival": 1, "bundle_id": D.BUNDLE_ID, "type": "Consumable", "ownership": "PURCHASED",
            "quantity": 1, "product_id": D.STORE_PRODUCTS[0][0], "app_account_token": token.upper()}
    cases = [good, *[{**good, k: None} for k in ("bundle_id", "type", "ownership", "quantity", "product_id", "signed_date",
                                                  "environment", "app_account_token", "transaction_id")],
             {**good, "signed_date": 0}, {**good, "environment": "Sandbox"}]
    cases = [{**c, "id": i, "transaction_id": c["transaction_id"] and f"{i}00"} for i, c in enumerate(cases)]
    schema = ("id long, user_id long, transaction_id string, seq long, environment string, revoked boolean, signed_date long, "
              "arrival long, bundle_id string, type string, ownership string, quantity int, product_id string, "
              "app_account_token string")
    feed = spark.createDataFrame([tuple(c[f.split()[0]] for f in schema.split(", ")) for c in cases], schema)
    got = {r.id: r.reject_reason for r in purchases.purchase_validation(feed, users).collect()}
    assert got == {0: None, 1: "unsupported_purchase", 2: "unsupported_purchase", 3: "unsupported_purchase",
                   4: "unsupported_purchase", 5: "unsupported_purchase", 6: "missing_date", 7: "sandbox_not_allowed",
                   8: "different_account", 9: "invalid_transaction_id", 10: "missing_date", 11: "sandbox_not_allowed"}


def test_numbers_in_metadata_follow_the_services_number_type(spark):
    cases = {"5000000": 5000000, " 5e6\n": 5000000, "0x10": 16, "0b11": 3, "0o17": 15, "5.0": 5, ".5e1": 5, "+7": 7,
             " 8﻿": 8, "9007199254740991": 9007199254740991, "0x1fffffffffffff": 9007199254740991,
             "0x20000000000000": None, "0xffffffffffffffffffff": None, "5000000d": None, "5f": None, "NaN": None,
             "Infinity": None, "": None, "1.5": None, "0": None, "-3": None, "-0x10": None, "9007199254740992": None,
             "1_000": None, None: None}
    df = spark.createDataFrame([(s,) for s in cases], "s string")
    got = {r.s: r.n for r in df.select("s", ledger.safe_positive_int(F.col("s")).alias("n")).collect()}
    assert got == cases


def test_money_text_rounds_the_exact_double(spark):
    from decimal import ROUND_HALF_UP, Decimal
    rnd = random.Random(1)
    micros = [1_005_000, 1_125_000, 15_000, 995_000, 0, 4_999, 5_000, 5_001, 125_000, 8_575_000, 9_007_199_254_735_000]
    micros += [rnd.randrange(10**9) * 5_000 for _ in range(400)] + [rnd.randrange(10**14) for _ in range(200)]
    micros += [rnd.randrange(10**5) * 50 for _ in range(300)]
    df = spark.createDataFrame([(m,) for m in micros], "m long")
    for r in df.select("m", ledger.fixed_text(F.col("m"), 2).alias("two"), ledger.fixed_text(F.col("m"), 4).alias("four")).collect():
        exact = Decimal(r.m / 1e6)
        assert r.two == str(exact.quantize(Decimal("0.01"), ROUND_HALF_UP)), r
        assert r.four == str(exact.quantize(Decimal("0.0001"), ROUND_HALF_UP)), r
    got = spark.createDataFrame([(-1_005_000,), (9_999,), (-10_000,)], "m long").select(
        ledger.usd(F.col("m")).alias("u"), ledger.history_amount(F.col("m")).alias("h")).collect()
    assert [tuple(r) for r in got] == [("-$1.00", "−$1.00"), ("$0.01", "+$0.0100"), ("-$0.01", "−$0.01")]


def test_email_white_space_is_the_services(spark):
    cases = {" A@b.co﻿": True, "a b@c.de": False, "a@b .de": False, "a@b.c　d": False, "a b@c.de": False}
    df = spark.createDataFrame([(s,) for s in cases], "s string")
    got = df.select("s", identity.valid_email(identity.normalise_email(F.col("s"))).alias("ok")).collect()
    assert {r.s: r.ok for r in got} == cases


def test_choice_names_that_are_indices_come_first(spark):
    df = spark.createDataFrame([("b: x; 10: ten; 2: two; a; 01: z; 4294967295: big; 2: again",)], "t string")
    got = df.select(textprep.parse_choices(F.col("t")).alias("c")).first().c
    assert [(c["name"], c["description"]) for c in got] == [
        ("2", "again"), ("10", "ten"), ("b", "x"), ("a", "a"), ("01", "z"), ("4294967295", "big")]


def test_repeated_json_names_keep_the_last(spark):
    df = spark.createDataFrame([('say {"a":1,"a":2} end',)], "t string")
    text = df.select(textprep.json_object_text(F.col("t")).alias("o")).first().o
    assert text is not None and json.loads(text) == {"a": 2}


def test_unlisted_status_is_another_failure(spark):
    df = spark.createDataFrame([(418,), (None,)], "status int")
    assert {r.label for r in kpi.with_status_label(df).collect()} == {"Other failure"}
