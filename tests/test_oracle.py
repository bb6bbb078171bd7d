"""Every registered query vs its DuckDB oracle on the sf0.001 tables (the driver's gate,
run locally); queries without an oracle must run and return a stable schema."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from meterline.plans import registry
from meterline.sources.tables import TABLES
from tools.compare_oracle import rows_of

SF = os.environ.get("METERLINE_TEST_SF", "/root/testdata/sf0.001")
QUERIES = {n: f for n, f in entry.queries().items() if n in registry.QUERIES}
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    yield c
    c.close()


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = df.columns
    rows = [tuple(r) for r in df.collect()]
    assert len(set(cols)) == len(cols)
    if name not in ORACLE:
        assert df.schema == QUERIES[name](spark, SF).schema  # stable schema
        return
    cur = con.execute(ORACLE[name])
    dcols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(dcols)
    assert rows_of(cols, rows) == rows_of(dcols, cur.fetchall())


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() == 1
    assert df.columns == ["active", "repeat_users", "previous_repeat_users", "previous_active", "retained", "lapsed"]
