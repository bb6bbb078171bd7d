import random
import re

from pyspark.sql import functions as F

from meterline.llm import quality
from tests.llm.conftest import EDGE

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    tri = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, w in enumerate(tri) if tri.count(w) > 1 for j in (i, i + 1, i + 2)}
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(covered))


def test_measures_match_plain_version(make_docs):
    rnd = random.Random(3)
    vocab = ["a", "b", "é#", "c\n", "\n", "d\t", "$%", "ß", "e\x0b", " ", "x|y"]
    rows = EDGE + [(100 + i, " ".join(rnd.choice(vocab) for _ in range(rnd.randrange(90)))) for i in range(60)]
    got = quality.ledger(make_docs(rows)).collect()
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) \
        == sorted((str(i), *plain(t)) for i, t in rows)
    for r in got:
        assert bool(r.failed & quality.POLICIES["base"]) == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    assert quality.ledger(make_docs([])).count() == 0


def test_ablation_equals_reapplying_the_policy(make_docs):
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice(["aa", "bb!", "##", "cc"]) + str(rnd.randrange(40)) for _ in range(rnd.randrange(120))))
            for i in range(80)]
    led = quality.ledger(make_docs(rows)).cache()
    failed = [r.failed for r in led.collect()]
    mask = quality.POLICIES["v1"]
    for r in quality.ablation(led, "v1").collect():
        bit = quality.BIT[r.rule]
        assert r.n_failed == sum(bool(x & bit) for x in failed)
        assert r.n_rejected_alone == sum(x & mask == bit for x in failed)
        assert r.n_kept_without == sum(not x & mask & ~bit for x in failed)


def test_accepted_keeps_all_columns(make_docs):
    docs = make_docs([(1, " ".join(f"word{i}" for i in range(60))), (2, "short"), (3, None)])
    got = quality.accepted(docs, "v1")
    assert got.columns == docs.columns and [r.doc_id for r in got.select(F.col("doc_id")).collect()] == [1]
