import os
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterline.llm import langid, tokens
from tests.llm.conftest import EDGE

VOCAB = tokens.public_path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.01"


def segmentations(word):
    for cut in product([0, 1], repeat=len(word) - 1):
        parts, at = [], 0
        for i, c in enumerate(cut, 1):
            if c:
                parts.append(word[at:i])
                at = i
        yield parts + [word[at:]]


def test_forward_sums_all_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "ba", "aba", "▁ab", "bb"]
    rng = np.random.default_rng(3)
    model = langid.Model.learn([(lang, p, int(rng.integers(1, 50))) for lang in ("x", "y") for p in pieces], pieces)
    for word in ("a", "ab", "abab", "abbabab", "azb", "zz"):
        want = np.zeros(2)
        for parts in segmentations("▁" + word):
            rows = [model.probability[model.index[p]] if p in model.index
                    else np.full(2, langid.UNKNOWN) if len(p) == 1 else np.zeros(2) for p in parts]
            want += np.prod(rows, axis=0)
        assert np.allclose(model._forward(["▁" + word])[0], np.log(want))


def test_long_words_do_not_underflow():
    pieces = ["a"]
    model = langid.Model.learn([("x", "a", 1), ("y", "a", 2)], pieces)
    (lang, score), = model.predict(["z" * 500])
    assert lang in ("x", "y") and 0 <= score <= 1
    assert np.isfinite(model._forward(["▁" + "z" * 31])).all()


def test_edges_and_cache(make_docs, monkeypatch):
    docs = make_docs([(i, "the cat and the dog" if i % 2 else "le chat et le chien") for i in range(40)]).withColumn(
        "lang", F.when(F.col("doc_id") % 2 == 1, "en").otherwise("fr"))
    parts = langid.learn(docs, VOCAB)
    rows = EDGE + [(100, "12 34 !!"), (101, "the dog"), (102, "le chien"), (103, "THE DOG"), (104, "中文")]
    got = langid.predict(make_docs(rows), parts).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r.lang_pred for r in got}
    assert [by_id[i] for i in (2, 3, 100, 101, 102, 103)] == ["und", "und", "und", "en", "fr", "en"]
    assert by_id[104] in ("en", "fr")
    monkeypatch.setattr(langid, "WORD_CACHE", 3)
    model = langid.Model.learn([(r.lang, parts[1][r.at], r.n) for r in parts[0].where("at IS NOT NULL").collect()], parts[1])
    first = model.predict(["the cat sat on a mat"] * 2)
    assert model.predict(["le chien est la"]) and model.predict(["the cat sat on a mat"] * 2) == first
    nothing = langid.learn(docs.where("false"), VOCAB)
    assert {r.lang_pred for r in langid.predict(make_docs([(1, "text")]), nothing).collect()} == {"und"}
    assert langid.predict(make_docs([]), parts).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = langid.held_out()
    parts = langid.learn(docs.where(~held), VOCAB)
    got = (langid.predict(docs.where(held), parts).join(docs, "doc_id").where("length(text) > 200")
           .agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0])
    assert got > 0.97


def test_marks_belong_to_their_words():
    assert langid.words_of("\u0939\u093f\u0928\u094d\u0926\u0940 \u092d\u093e\u0937\u093e x2y") == [
        "\u0939\u093f\u0928\u094d\u0926\u0940", "\u092d\u093e\u0937\u093e", "x", "y"]
    assert langid.words_of("e\u0301te\u0301 \u0e20\u0e32\u0e29\u0e32\u0e44\u0e17\u0e22\u0e17\u0e35\u0e48") == [
        "e\u0301te\u0301", "\u0e20\u0e32\u0e29\u0e32\u0e44\u0e17\u0e22\u0e17\u0e35\u0e48"]
    assert langid.words_of("\u0301 1_2") == []
    for text in ("Ünï cödé", "e\u0301 \u4e2d\u6587", "a\u0300b c", "ÿ\u02ffz"):
        assert langid.words_of(text) == langid._WORD.findall(text.lower())


def test_long_words_are_scored_whole():
    pieces = ["▁", "▁a", "a", "b", "ab", "ba", "aba", "▁ab", "bb", "babab"]
    rng = np.random.default_rng(4)
    model = langid.Model.learn([(lang, p, int(rng.integers(1, 50))) for lang in ("x", "y", "z") for p in pieces], pieces)
    for n in (1, 2, 7, 31, 90, 400):
        word = "▁" + "".join(rng.choice(list("abq"), n))
        assert np.allclose(model._forward_one(word), model._forward([word])[0])
    text = "".join(rng.choice(list("ab"), 20_000))
    (total,) = model.totals([f"{text} ab"])
    assert np.allclose(total, model._forward_one("▁" + text) + model._forward_one("▁ab")) and text not in model.rows


def test_many_languages_go_in_passes(make_docs, monkeypatch):
    rows = [(i, " ".join(f"{c}{c}{d}{c}" for d in "aeiou") + f" {c}um") for i, c in enumerate("bcdfghjklmnp")] * 2
    docs = make_docs(rows).withColumn("lang", F.concat(F.lit("l"), F.col("doc_id").cast("string")))
    tested = make_docs(rows[:12] + EDGE + [(50, "bum bum cum"), (50, "bum bum cum"), (None, "dum")])
    whole = sorted((str(r.doc_id), r.lang_pred, round(r.score, 9)) for r in langid.predict(tested, langid.learn(docs, VOCAB)).collect())
    monkeypatch.setattr(langid, "LANGUAGES", 3)
    parts = langid.learn(docs, VOCAB)
    assert parts[2] > 2
    assert sorted((str(r.doc_id), r.lang_pred, round(r.score, 9)) for r in langid.predict(tested, parts).collect()) == whole
    assert {r[1] for r in whole} > {"und", "l0", "l3"}
