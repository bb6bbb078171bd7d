import random

import numpy as np

from meterline.llm import chunks
from tests.llm.conftest import EDGE

RND = random.Random(31)


def text(n, tag):
    return " ".join(f"{tag}{RND.randrange(10**6)}" for _ in range(n))


def test_cuts_cover_the_text_and_follow_content():
    words = text(2000, "w").split()
    digests, ends = chunks.chunk(" ".join(words).encode())
    assert ends[-1] == len(words) and (np.diff(ends) > 0).all() and np.diff(ends).max() <= chunks.LONGEST
    assert 3 <= len(words) / len(ends) <= 8
    shifted, _ = chunks.chunk(" ".join(["put", "in", "front", *words]).encode())
    assert len(set(digests) - set(shifted)) <= 3  # only the chunks at the insertion change
    same, ends = chunks.chunk(b"a " * 1000)
    assert ends[-1] == 1000 and np.diff(ends).max() <= chunks.LONGEST
    assert chunks.chunk(b" \n")[0] == []


def plain_shared(a, b):
    """Longest run of words that two texts share."""
    x, y = (a or "").split(), (b or "").split()
    best, last = 0, [0] * (len(y) + 1)
    for w in x:
        now = [0] * (len(y) + 1)
        for j, v in enumerate(y, 1):
            if w == v:
                now[j] = last[j - 1] + 1
                best = max(best, now[j])
        last = now
    return best


def test_repeated_passages_are_found_and_clean_texts_left(make_docs):
    passages = [text(55 + i, "p") for i in range(12)]
    rows = EDGE[:8] + [(100 + i, text(120, "u")) for i in range(12)]
    for i, p in enumerate(passages):
        rows += [(200 + 3 * i + k, f"{text(20 + k, 'x')}\n{p}  {text(15, 'y')}") for k in range(3)]
    rows += [(400, rows[10][1]), (300, text(200, "z")), (301, text(200, "z"))]
    found = chunks.repeats(make_docs(rows))
    got = found.collect()
    flagged = {r.doc_id for r in got}
    for i in range(12):
        assert {201 + 3 * i, 202 + 3 * i} <= flagged and 200 + 3 * i not in flagged
        assert all(r.first_doc_id in (200 + 3 * i, 201 + 3 * i) for r in got if r.doc_id in (201 + 3 * i, 202 + 3 * i))
    by_id = dict(rows)
    for r in got:  # every reported run stands word for word in another text
        run = " ".join(by_id[r.doc_id].split()[r.start_word:r.start_word + r.n_words])
        assert any(run in " ".join((t or "").split()) for i, t in rows if i != r.doc_id) or r.doc_id == 400
    assert not flagged & {300, 301, *range(100, 112)}
    assert 400 in flagged
    clean = chunks.without_repeats(make_docs(rows), found)
    texts = {}
    for r in clean.collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    assert sum(map(len, texts.values())) == len(rows)
    assert texts[200] == [by_id[200]] and len(texts[201][0].split()) < len(by_id[201].split()) - 15
    assert texts[400][0].split() == [] or len(texts[400][0].split()) < 5
    assert chunks.repeats(make_docs([])).count() == 0


def test_rows_equal_in_id_and_text_are_one_text(make_docs):
    t = text(100, "r")
    assert chunks.repeats(make_docs([(1, t), (1, t)])).count() == 0
    other = chunks.repeats(make_docs([(1, t), (2, t), (None, t)])).collect()
    assert {r.doc_id for r in other} == {1, 2} and {r.first_doc_id for r in other} == {None}
    assert all(plain_shared(t, t) >= r.n_words for r in other)


def test_texts_that_share_an_id_or_have_none_are_different_documents(make_docs):
    p, q = text(60, "s"), text(60, "t")
    rows = [(1, f"{text(30, 'a')} {p}"), (1, f"{text(30, 'b')} {p}"), (None, f"{text(30, 'c')} {q}"), (None, f"{q} {text(30, 'd')}"),
            (7, f"{text(20, 'e')} {q} {text(9, 'f')}"), (8, text(80, "g"))]
    got = chunks.repeats(make_docs(rows)).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.n_words, r.first_doc_id))
    assert len(by[1]) == 1 and by[1][0][0] > 40 and by[1][0][1] == 1  # one of the two comes first
    assert len(by[None]) == 1 and by[None][0][1] is None and by[7][0][1] is None and 8 not in by
