import random

import numpy as np
import pytest

from meterline.llm import decontam
from tests.llm.conftest import EDGE

RND = random.Random(21)
ITEMS = [(i, " ".join(f"q{RND.randrange(5000)}" for _ in range(n))) for i, n in enumerate((20, 20, 31, 5, 4, 1, 60))]


def plain(text, items, threshold=0.8):
    words, found = decontam.words_of((text or "").encode()), set()
    for item_id, item in items:
        own = decontam.words_of((item or "").encode())
        k = min(5, len(own))
        if own and any(decontam.similarity(words[i:i + len(own)], own, k) >= threshold
                       for i in range(max(1, len(words) - len(own) + 1))):
            found.add(item_id)
    return found


def changed(text, at, n=1):
    words = text.split()
    words[at:at + n] = ["changed"] * n
    return " ".join(words)


def test_finds_exact_and_near_passages_like_plain_search(spark, make_docs):
    noise = " ".join(f"n{i}" for i in range(300))
    rows = EDGE + [(100, noise)]
    for i, (item_id, item) in enumerate(ITEMS):
        rows += [(200 + i, f"{noise} {item.upper().replace(' ', ', ')} {noise}"), (300 + i, item), (400 + i, changed(item, 0)),
                 (500 + i, noise + " " + changed(item, len(item.split()) // 2)), (600 + i, f"{item} {noise} {item}")]
    rows += [(700, " ".join([ITEMS[0][1]] * 40))]
    for i, (item_id, item) in enumerate(ITEMS):  # texts that are an item less some of its words
        rows += [(800 + 10 * i + cut, " ".join(item.split()[cut // 2:len(item.split()) - (cut + 1) // 2])) for cut in (1, 2, 3, 5, 9)]
    bench = spark.createDataFrame(ITEMS + [(90, None), (91, ""), (92, "..."), ITEMS[0]], "item_id long, text string")
    got = decontam.matches(make_docs(rows), bench).collect()
    want = {(i, x) for i, t in rows for x in plain(t, ITEMS)}
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert {200 + i for i in range(len(ITEMS))} <= {r.doc_id for r in got} and 100 not in {r.doc_id for r in got}
    twice = [r for r in got if r.doc_id == 606 and r.item_id == 6]
    assert len(twice) == 2 and all(r.similarity == 1.0 and r.distance == 0 for r in twice)
    in_blocks = decontam.matches(make_docs(rows), bench, block_bytes=400)
    assert sorted(map(str, in_blocks.collect())) == sorted(map(str, got))
    kept = decontam.clean(make_docs(rows), bench)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(
        str(i) for i, t in rows if not plain(t, ITEMS))
    assert kept.columns == make_docs(rows).columns
    assert decontam.matches(make_docs([]), bench).count() == 0
    assert decontam.matches(make_docs(rows), bench.where("false")).count() == 0


@pytest.mark.parametrize("radius,blocks", [(3, 4), (7, 4), (19, 10)])
def test_blocks_find_every_fingerprint_within_the_radius(radius, blocks):
    index = decontam.Index([], 5, 0.8, radius, blocks)
    rnd = random.Random(radius)
    marks = [rnd.getrandbits(64) for _ in range(50)]
    at = {"blocks": {}, "items": [(i, [], m) for i, m in enumerate(marks)]}
    for i, m in enumerate(marks):
        for p, (lo, mask, _) in enumerate(index.parts):
            at["blocks"].setdefault((p, m >> lo & mask), []).append(i)
    for _ in range(200):
        i, x = rnd.randrange(50), 0
        for b in rnd.sample(range(64), rnd.randrange(radius + 3)):
            x |= 1 << b
        got = index._near(at, marks[i] ^ x)
        assert got == {j for j, m in enumerate(marks) if (m ^ marks[i] ^ x).bit_count() <= radius}


def test_similarity_counts_repeats():
    a, b = [b"a", b"b", b"a", b"b"], [b"a", b"b"]
    assert decontam.similarity(a, b, 1) == 2 / 4 and decontam.similarity(a, a, 2) == 1.0
    assert len(decontam.shingle_hashes(np.array([1, 2], dtype=np.uint64), 3)) == 0


def test_word_hashes_follow_the_words(monkeypatch):
    text = decontam.plain("One two, ONE  éé/ÉÉ 12 " .encode() + b"x" * 90 + b" one")
    words, hashes = text.split(), decontam.hash_words(text)
    assert len(words) == len(hashes)
    by_word = {}
    for w, h in zip(words, hashes.tolist()):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)
    monkeypatch.setattr(decontam, "_SLICE", 7)
    assert decontam.hash_words(text).tolist() == hashes.tolist()
    assert len(decontam.hash_words(b"")) == 0 and len(decontam.hash_words(b"   ")) == 0


def test_windows_equal_plain_ones(monkeypatch):
    monkeypatch.setattr(decontam, "STEP", 7)
    rng = np.random.default_rng(5)
    shingles = rng.integers(0, 1 << 62, 300).astype(np.uint64)
    for n, least, some in ((20, 5, 60), (1, 1, 30), (50, 40, 250), (7, 3, 40)):
        hits = np.sort(rng.choice(290, some, replace=False))
        last = 300 - n
        got = list(decontam.Index._windows(shingles, hits, least, n, last))
        want = [(j, decontam.simhash(shingles[j:j + n])) for j in range(last + 1) if ((hits >= j) & (hits < j + n)).sum() >= least]
        assert got == want
