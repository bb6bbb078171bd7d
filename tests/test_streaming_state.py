"""Streaming folds keep their state across micro-batches: events split into three
time-ordered files, one file per trigger, must equal the batch fold."""

import os
import tempfile
import time

import pyarrow.parquet as pq
import pytest

from meterline.operators import folds
from meterline.sources.derived import Model
from meterline.streaming import stateful

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


@pytest.fixture(scope="module")
def split_dir():
    t = pq.read_table(f"{SF}/events.parquet").sort_by("ts")
    d = tempfile.mkdtemp(prefix="meterline-split-")
    n = t.num_rows
    for i, (a, b) in enumerate([(0, n // 3), (n // 3, 2 * n // 3), (2 * n // 3, n)]):
        pq.write_table(t.slice(a, b - a), f"{d}/events_{i}.parquet")
        time.sleep(1.1)  # file source orders files by modification time
    return d


def rows(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_rate_limit_state_carries_across_batches(spark, split_dir):
    got = stateful.rate_limit_stream(spark, split_dir, 15 * 60 * 1000, 10, max_files=1, glob="events_*.parquet")
    ev0 = Model(spark, SF).ev0
    from pyspark.sql import functions as F
    hits = ev0.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("id"),
                      F.col("created_at").alias("ts"))
    exp = folds.rate_limit_flags(hits, 15 * 60 * 1000, 10)
    cols = ["key", "id", "ts", "window_start", "n", "allowed"]
    assert rows(got, cols) == rows(exp, cols)


def test_conditional_debits_state_carries_across_batches(spark, split_dir):
    got = stateful.conditional_debit_stream(spark, split_dir, max_files=1, glob="events_*.parquet")
    exp = folds.conditional_debits(Model(spark, SF).ledger)
    cols = ["id", "user_id", "accepted", "balance_after"]
    assert rows(got, cols) == rows(exp, cols)
