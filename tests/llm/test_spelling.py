import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterline.llm import queries, spelling
from tests.llm.conftest import EDGE

SF = "/root/testdata/sf0.001"


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_counts(docs, thin=97):
    total = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if thin and h % thin == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            total[run] += 1
    return total


def plain(total, least=5, count=3):
    words = {w: n for w, n in total.items() if len(w) >= least and n >= count}
    by = {}
    for w in words:
        by.setdefault(len(w), []).append(w)
    close = {w: [v for size in (len(w) - 1, len(w), len(w) + 1) for v in by.get(size, ()) if near(w, v)] for w in words}
    form = {}
    for w, vs in close.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(close[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def made(spark, docs, thin=97):
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("word", F.lit("x")).withColumn("n", F.lit(1))
    return sorted(map(tuple, spelling.variants(spelling.word_counts(df.repartition(3), thin=thin)).collect()))


def noisy(n, seed, vocabulary=60):
    rng = np.random.default_rng(seed)
    letters = list("abcdeÀéÿö")
    words = ["".join(rng.choice(letters, rng.integers(4, 9))) for _ in range(vocabulary)]
    docs = []
    for i in range(n):
        text = []
        for w in rng.choice(words, 40, p=np.arange(1, vocabulary + 1) / sum(range(1, vocabulary + 1))):
            w = list(w)
            if rng.random() < 0.3:
                at, kind = int(rng.integers(len(w))), int(rng.integers(3))
                w[at:at + (kind > 0)] = [] if kind == 2 else [str(rng.choice(letters))]
            text.append("".join(w).upper() if rng.random() < 0.1 else "".join(w))
        docs.append((i, " ".join(text) + "1.x"))
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_pairs(spark, seed):
    docs = noisy(120, seed)
    want = plain(plain_counts(docs))
    got = made(spark, docs)
    assert got == want and any(r[1] for r in want)


def test_whole_small_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.QUERIES["op11_spelling_variants"](spark, SF)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect())) == plain(plain_counts(docs))


def test_several_broadcasts_and_long_words(spark, monkeypatch):
    monkeypatch.setattr(spelling, "SENT_BYTES", 256)
    monkeypatch.setattr(spelling, "EDITS", 500)
    monkeypatch.setattr(spelling, "HELD", 50)
    docs = noisy(60, 3) + [(1000 + i, w) for w in ("q" * 5000, "q" * 4999, "q" * 63, "q" * 64, "q" * 65) for i in range(3)]
    docs += [(2000 + i, "q" * 63 + "z") for i in range(9)]
    assert made(spark, docs, None) == plain(plain_counts(docs, None))


def test_edges(spark):
    rows = EDGE * 3 + [(None, "tiers tiers tiers"), (9, "ABCDE abcdf")] * 3
    assert made(spark, rows) == plain(plain_counts(rows))
    assert made(spark, []) == []
    assert made(spark, [(1, None), (2, ""), (3, "12 34")]) == []


def test_chain_of_forms(spark):
    words = [f"{'b' * i}{'a' * (12 - i)}" for i in range(9)]  # each is one replacement from the next
    docs = [(1, " ".join([w] * (3 << i))) for i, w in enumerate(words)]
    got = {r[0]: r for r in made(spark, docs, None)}
    assert [got[w][2] for w in words] == [words[-1]] * 9 and got[words[0]][1] == words[1] and got[words[-1]][1] is None


def test_filter_lets_few_edits_through(spark):
    docs = [(1, " ".join(["".join(np.random.default_rng(i).choice(list("abcdefghij"), 8)) for i in range(3000)] * 3))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    words = spelling.word_counts(df).where("n >= 3 and length(word) >= 5")
    shards = spelling.Shards({r[0]: r[1] for r in words.groupBy(F.length("word")).count().collect()})
    made_bits = spelling._filter(words, shards).collect()
    bits = np.zeros(shards.total * 8, dtype=np.uint64)
    for slot, b in made_bits:
        bits[slot] = np.uint64(b & (2 ** 64 - 1))
    known = spelling._known(words, shards, bits, 0, shards.total, spelling.ALPHABET, 5).count()
    edits = 3000 * 8 * 60
    assert known < edits * 0.01
