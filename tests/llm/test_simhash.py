import random

import pytest
import xxhash
from pyspark.sql import functions as F

from meterline.llm import simhash
from meterline.llm.components import components
from tests.llm.conftest import EDGE


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words)] if len(words) < 3 else [" ".join(words[i:i + 3]) for i in range(len(words) - 2)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def roots(nodes, near):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in enumerate(nodes):
        for b in nodes[i + 1:]:
            if near(a, b):
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {n: find(n) for n in nodes}


def test_fingerprint_matches_plain_version_and_spark_hash(spark):
    rnd = random.Random(5)
    for n in (0, 1, 2, 3, 4, 50, 400):
        text = " ".join(rnd.choice(["Ab", "é", "CD", "x\ty", "z\n"]) for _ in range(n))
        assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)
    got = spark.range(1).select(F.xxhash64(F.lit("ab cd")).alias("x")).first().x
    assert got % (1 << 64) == xxhash.xxh64_intdigest(b"ab cd", 42)


@pytest.mark.parametrize("n", [1, 60])
def test_components_match_union_find(spark, n):
    rnd = random.Random(n)
    pairs = [(rnd.randrange(80), rnd.randrange(80)) for _ in range(n)] + [(200 + i, 201 + i) for i in range(40)] + [(9, None)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    links = {(a, b) for a, b in pairs if b is not None and a != b}
    nodes = sorted({x for p in links for x in p})
    assert got == roots(nodes, lambda a, b: (a, b) in links or (b, a) in links)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("radius,bucket", [(1, 16), (2, 16), (2, 1), (3, 16), (3, 2)])
def test_close_pairs_lose_no_link(spark, radius, bucket):
    rnd = random.Random(radius * 7 + bucket)
    fps = {rnd.getrandbits(64) for _ in range(40)}
    for centre in list(fps)[:4]:  # clusters of close fingerprints, some chained beyond the radius
        for _ in range(12):
            x = centre
            for _ in range(rnd.randrange(1, 4)):
                x ^= 1 << rnd.randrange(64)
            fps.add(x)
    signed = sorted(simhash.signed(x) for x in fps)
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    links = simhash.close_pairs(df, radius, bucket)
    pairs = {(r.a, r.b) for r in links.collect()}

    def apart(a, b):
        return ((a ^ b) % (1 << 64)).bit_count()
    assert all(apart(a, b) <= radius for a, b in pairs)
    want = roots(signed, lambda a, b: apart(a, b) <= radius)
    got = {r.node: r.root for r in components(links).collect()}
    assert {x: got.get(x, x) for x in signed} == want


def test_near_duplicates_edges(make_docs):
    rows = EDGE + [(20 + i, "a long passage of words that is the same " * 3) for i in range(30)]
    got = simhash.near_duplicates(make_docs(rows)).collect()
    assert len(got) == len(rows)
    ids = [r for r in rows]
    fps = sorted({simhash.signed(plain_fingerprint(t)) for _, t in ids})
    root = roots(fps, lambda a, b: ((a ^ b) % (1 << 64)).bit_count() <= 2)
    least = {}
    for i, t in ids:
        r = root[simhash.signed(plain_fingerprint(t))]
        if i is not None:
            least[r] = min(least.get(r, i), i)
    want = sorted((str(i), least.get(root[simhash.signed(plain_fingerprint(t))])) for i, t in ids)
    assert sorted((str(r.doc_id), r.component_id) for r in got) == want
    assert simhash.near_duplicates(make_docs([])).count() == 0


def test_one_of_each_keeps_one_row_and_its_columns(make_docs):
    docs = make_docs(EDGE)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    found = simhash.near_duplicates(docs).collect()
    assert len(got) == len({r.root for r in found})
    assert {r.doc_id for r in got} == {r.component_id for r in found}
    assert simhash.one_of_each(make_docs([])).count() == 0


def test_no_side_of_a_join_goes_by_way_of_the_driver(make_docs, monkeypatch):
    plans, whole = [], simhash.save

    def kept(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return whole(df, name)
    monkeypatch.setattr(simhash, "save", kept)
    monkeypatch.setitem(components.__globals__, "save", kept)
    rows = EDGE + [(20 + i, "a long passage of words that is the same " * 3 + str(i % 3)) for i in range(30)]
    found = simhash.near_duplicates(make_docs(rows))
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert found.count() == len(rows)
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)
