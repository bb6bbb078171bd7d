"""Invariants across jobs: totals = sum of cohorts, daily sums = period
sums, running balance ends at the ledger balance, folds never overdraw."""

import json
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
Q = entry.queries()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


def test_dashboard_internal_consistency(spark):
    d = json.loads(Q["dashboard_json"](spark, SF).collect()[0].json)
    assert len(d["daily"]) == d["days"]
    assert sum(x["runs"] for x in d["daily"]) == d["current"]["runs"]
    assert sum(x["active"] for x in d["daily"]) >= d["current"]["active"]
    for k, v in d["totals"].items():
        assert v == sum(c[k] for c in d["cohorts"]), k
    assert [f["attempts"] for f in d["failures"]] == sorted((f["attempts"] for f in d["failures"]), reverse=True)
    assert [(f["users"], f["runs"]) for f in d["features"]] == \
        sorted(((f["users"], f["runs"]) for f in d["features"]), reverse=True)
    assert d["coverage"]["weekly"] is True


def test_running_balance_ends_at_ledger_balance(spark):
    last = (Q["running_balance"](spark, SF).groupBy("user_id")
            .agg(F.max_by("balance_micros", F.struct("created_at", "id")).alias("b")))
    bal = Q["ledger_balances"](spark, SF).where(F.col("n_rows") > 0)
    joined = last.join(bal, "user_id")
    assert joined.count() == bal.count()
    assert joined.where(F.col("b") != F.col("balance_micros")).count() == 0


def test_folds_never_overdraw(spark):
    assert Q["conditional_debits"](spark, SF).where(F.col("balance_after") < 0).count() == 0
    assert Q["purchase_states"](spark, SF).where(F.col("balance_after") < 0).count() == 0


def test_settlement_never_charges_more_than_reserved(spark):
    s = Q["settlement"](spark, SF)
    assert s.where(F.col("actual_micros") > F.col("reserved_micros")).count() == 0
    assert s.where((F.col("status") == 200) & (F.col("refund_micros") < 0)).count() == 0


def test_erasure_leaves_no_orphans(spark):
    assert all(r.orphans == 0 for r in Q["orphans"](spark, SF).collect())
    assert Q["id_reuse_violations"](spark, SF).count() == 0
