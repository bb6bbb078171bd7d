import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterline.llm import ppm, queries
from tests.llm.conftest import EDGE

SF = "/root/testdata/sf0.001"


class Plain:
    """The same model as nested dicts, walked sign by sign with explicit sets of excluded signs."""

    def __init__(self, texts):
        self.trie, self.words = {}, Counter()
        for t in texts:
            data = (t or "").encode().lower()
            for ctx, sign in self.steps(data):
                for order in range(5):
                    self.trie.setdefault(ctx[4 - order:], Counter())[sign] += 1
            self.words.update(data.split() + [b""])

    @staticmethod
    def steps(data):
        padded = b"\0" * 4 + data
        for i in range(len(data) + 1):
            yield padded[i:i + 4], data[i] if i < len(data) else 256

    def score(self, text):
        total = 0.0
        for ctx, sign in self.steps((text or "").encode().lower()):
            out = set()
            for order in range(4, -1, -1):
                counted = self.trie.get(ctx[4 - order:])
                if not counted:
                    continue
                left = {s: n for s, n in counted.items() if s not in out}
                t, q = sum(left.values()), len(left)
                if sign in left:
                    total += math.log10(left[sign] / (t + q))
                    break
                if q:
                    total += math.log10(q / (t + q))
                out |= set(left)
            else:
                total -= math.log10(257 - len(out))
        return total

    def base(self, text):
        words = (text or "").encode().lower().split() + [b""]
        n, v = sum(self.words.values()), len(self.words)
        return (len(words), sum(w in self.words for w in words), n,
                sum(math.log10((self.words[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words))


def scored(spark, train, docs):
    schema = "doc_id long, text string"
    model = ppm.learn(spark.createDataFrame(train, schema))
    df = spark.createDataFrame(docs, schema).withColumn("score", F.lit(1)).withColumn("h", F.lit("x")).withColumn("n_tokens", F.lit(2))
    return model, ppm.score(df.repartition(3), model).collect()


def same(rows, docs, model):
    want = sorted((str(i), *model.base(t), model.score(t)) for i, t in docs)
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in rows)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:4] == w[:4] and g[4:] == pytest.approx(w[4:], rel=1e-9, abs=1e-9)


def texts(n, seed):
    rng = np.random.default_rng(seed)
    return [(i, "".join(rng.choice(list("abcab ab\nÄz"), rng.integers(0, 120)))) for i in range(n)]


def test_equals_the_plain_model(spark):
    train, docs = texts(25, 1), texts(25, 2) + [(90, "zebra Quagga ÄÄ \x00\x00x"), (91, "日本語 xyz")] + EDGE
    _, rows = scored(spark, train, docs)
    same(rows, docs, Plain([t for _, t in train]))


def test_blocks_pieces_and_hand_overs(spark, monkeypatch):
    for name, value in (("PIECE", 50), ("HELD", 60), ("BLOCK", 150), ("UNIT", 40), ("WORD_BYTES", 700)):
        monkeypatch.setattr(ppm, name, value)
    train, docs = texts(30, 3), texts(20, 4) + [(1, "a b c"), (1, "a b c"), (None, "a b c"), (None, None)]
    model, rows = scored(spark, train, docs)
    assert model.passes > 2 and 0 < model.frequent.count() < model.distinct
    same(rows, docs, Plain([t for _, t in train]))


def test_nothing_learned_and_no_rows(spark):
    _, rows = scored(spark, [], [(1, "ab"), (2, None)])
    got = {r["doc_id"]: r for r in rows}
    assert got[1]["score"] == pytest.approx(-3 * math.log10(257)) and got[2]["score"] == pytest.approx(-math.log10(257))
    assert got[1]["base_score"] == pytest.approx(0) and got[1]["n_known"] == 0 and got[1]["train_tokens"] == 0
    assert scored(spark, texts(3, 5), [])[1] == []


def test_probabilities_of_all_signs_add_up(spark):
    train = texts(12, 6)
    model, _ = scored(spark, train, [])
    block = ppm.Block(*model.sent(0).value[:4])
    for ctx in (b"\0\0\0\0", b"abca", b"zzzz", b"b ab", b"\xf0\x01ab", b"\xf0\x01\x02b"):
        key = (int.from_bytes(ctx, "big") << 9) | np.arange(257, dtype=np.int64)
        assert (10 ** block.score(key)).sum() == pytest.approx(1)


def test_lookup():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 50, 5000))
    look = ppm.Lookup(keys)
    assert (look.get(keys) == np.arange(len(keys))).all()
    other = np.setdiff1d(np.random.default_rng(2).integers(0, 1 << 50, 5000), keys)
    assert (look.get(other) == -1).all()


def test_registered_on_a_whole_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.QUERIES["op12_lm_scoring"](spark, SF)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    rows = got.collect()
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in docs}
    assert {r["doc_id"]: r["held_out"] for r in rows} == held
    plain = Plain([t for i, t in docs if not held[i]])
    some = [d for d in docs if len(d[1] or "") < 3000][:60]
    same([r for r in rows if r["doc_id"] in dict(some)], some, plain)
    mean = [sum(r["score"] for r in rows if r["held_out"] == h) / sum(len((dict(docs)[r["doc_id"]] or "").encode()) + 1 for r in rows if r["held_out"] == h)
            for h in (True, False)]
    assert -1.0 < mean[0] < 0 and mean[0] <= mean[1] + 0.05  # texts not learned from cost more, far less than uniform (2.41)
