import os

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from meterline.llm import decontam, quality
from meterline.llm.common import save, table
from meterline.llm.queries import QUERIES
from tests.llm.conftest import EDGE

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_work_on_what_the_one_before_kept(spark):
    docs, seen = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, save(stage(spark, docs, SF), name)
        seen.append((name, before, docs))
    (_, raw, good), (_, _, lined), (_, _, near), (_, _, clean), (_, _, packed) = seen
    assert all(d.columns == COLUMNS for _, _, d in seen[:-1])
    kept = {r.doc_id: r for r in good.collect()}
    assert set(kept) == {r.doc_id for r in quality.ledger(raw).where(quality.verdict("v1")).collect()}
    after = {r.doc_id: r for r in lined.collect()}
    assert set(after) == set(kept) and all(r.n_chars == len(r.text) for r in after.values())
    for i, r in after.items():  # what stays is a subsequence of the lines that were there
        lines = iter(kept[i].text.split("\n"))
        assert r.text == "" or all(x in lines for x in r.text.split("\n"))
    from tests.llm.test_simhash import plain_fingerprint, roots
    fps = {i: plain_fingerprint(r.text) for i, r in after.items()}
    root = roots(sorted(set(fps.values())), lambda a, b: (a ^ b).bit_count() <= 2)
    first = {}
    for i, fp in sorted(fps.items()):
        first.setdefault(root[fp], i)
    assert {r.doc_id for r in near.collect()} == set(first.values())
    bench = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    index = decontam.Index([(i, t.encode()) for i, t in bench], 5, 0.8, 19, 10)
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in near.collect() if not index.matches(r.text.encode())}
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in clean.collect()}


def test_stages_take_nulls_repeats_and_empty_tables(spark):
    rows = [(i, t, None, None, None) for i, t in EDGE] + [(60 + i, " ".join(f"w{j}" for j in range(60 + i % 2)), "en", "s", 1)
                                                         for i in range(4)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for given in (rows, []):
        docs = spark.createDataFrame(given, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = save(stage(spark, docs, SF), name)
        assert docs.count() == (2 if given else 0) or given  # quality keeps the four long ones
    assert docs.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_every_operator_is_registered_and_sql_is_given_where_it_can_be():
    names = entry.queries()
    assert {n.split("_")[0] for n in QUERIES if n != "quality_ablation"} == {f"op{i}" for i in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(names)
    assert {"op1_license_scan", "op3_quality_rules", "quality_ablation", "op13_hard_negatives"} <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", ["op1_license_scan", "op3_quality_rules", "quality_ablation", "op13_hard_negatives"])
def test_sql_agrees(spark, name):
    import duckdb

    from meterline.llm.queries import ORACLE
    from tools.compare_oracle import rows_of
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    cur = con.execute(ORACLE[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, cur.fetchall())
