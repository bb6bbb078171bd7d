import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from meterline.llm import bitplanes, packing, tokens
from tests.llm.conftest import EDGE

BYTE, WORDS = (tokens.public_path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
PIECES = ["Hello", "world's", "it's", "naïve", "été", "ΣΑΣ", "don't", " ", "  ", "\n", "\n\n", "\t", "\r\n", " ",
          " ", "\x1c", "\x00", "​", "<|endoftext|>", "<|", "3.14", "foo_bar", "é", "́x", "中文", "😀", "...", "\x85"]


def whole(path, text):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTE, WORDS])
def test_segments_encode_as_whole_texts(path):
    rnd = random.Random(11)
    texts = ["", " ", "\n", "a", " a ", "\n a\n"] + [
        "".join(rnd.choice(PIECES) + rnd.choice(["", " "]) for _ in range(rnd.randrange(1, 30))) for _ in range(400)]
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    enc = tokens.Encoder(path)
    for text, raw in zip(texts, enc.encode_batch(texts)):
        assert np.frombuffer(raw, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)
    assert enc.encode_batch(texts[:50]) == tokens.Encoder(path).encode_batch(texts[:50])


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 50)
    enc = tokens.Encoder(WORDS)
    for k in range(10):
        enc.encode_batch([" ".join(f"w{k}x{i}" for i in range(40))])
        assert len(enc.cache) <= 50 + 40


@pytest.mark.parametrize("path", [BYTE, WORDS])
def test_long_texts_go_in_pieces(path, monkeypatch):
    rnd = random.Random(12)
    texts = ["".join(rnd.choice(["Hello", "it's", "été", "...", "3.14"]) + rnd.choice([" ", "  ", "\n", " \n", ""])
                     for _ in range(rnd.randrange(1, 120))) for _ in range(60)]
    enc = tokens.Encoder(path)
    want = [enc.whole(t) for t in texts]
    for size in (1, 7, 40):
        monkeypatch.setattr(tokens, "PIECE", size)
        assert tokens.Encoder(path).encode_batch(texts) == want


@pytest.mark.parametrize("mode,width", [("byte", 2), ("bit", 2), ("byte", 4), ("bit", 4)])
def test_planes_round_trip(tmp_path, mode, width):
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 1 << (8 * width - 1), n, dtype=np.uint32) for n in (0, 1, 7, 5000, 3, 0, 64, 1)]
    path = tmp_path / "x"
    with open(path, "wb") as out:
        w = bitplanes.Writer(out, width, mode, block=64)
        for i, d in enumerate(docs):
            w.add(i if i else None, d)
        assert w.close() == (len(docs), sum(map(len, docs)))
    every = np.concatenate(docs)
    with open(path, "rb") as source:
        r = bitplanes.Reader(source, path.stat().st_size)
        assert [x for x in r.documents()] == [(i if i else None, len(d), zlib.crc32(d.astype("<u4").tobytes()))
                                              for i, d in enumerate(docs)]
        for lo, hi in ((0, 0), (0, 1), (63, 65), (100, 1000), (0, len(every))):
            assert (r.ids(lo, hi) == every[lo:hi]).all()
    data = bytearray(path.read_bytes())
    data[20] ^= 255
    path.write_bytes(data)
    with open(path, "rb") as source, pytest.raises(Exception):
        list(bitplanes.Reader(source, len(data)).documents())


def test_write_and_read_in_id_order(spark, make_docs):
    rows = EDGE[:-3] + [(6, "tie"), (7, "tie"), (-5, "minus"), (10**12, "far"), *[(50, f"same id {i}") for i in range(20)],
                        *[(100 + i, f"document number {i}\n" * (i % 7)) for i in range(60)]]
    manifest = bitplanes.write(make_docs(rows), bitplanes.folder(spark), BYTE, files=7, block=128)
    got = bitplanes.read(manifest).collect()
    assert manifest.count() > 1 and len(got) == len(rows)
    want = {}
    for i, t in rows:
        ids = np.array(whole(BYTE, t) + [0], "<u4")
        want.setdefault(i, []).append((len(ids), zlib.crc32(ids.tobytes())))
    assert {i: sorted(v) for i, v in want.items()} == {
        i: sorted((r.n_tokens, r.ids_crc32) for r in got if r.doc_id == i) for i in want}
    got.sort(key=lambda r: r.start)
    at, last = 0, -10**18
    for r in got:
        assert r.start == at and (r.doc_id is None or r.doc_id >= last)
        at, last = at + r.n_tokens, last if r.doc_id is None else r.doc_id
    empty = bitplanes.write(make_docs([]), bitplanes.folder(spark), BYTE)
    assert empty.count() == 0 and bitplanes.read(empty).count() == 0


def test_best_fit_takes_the_tightest_bin():
    rnd = random.Random(2)
    for capacity in (1, 7, 64):
        fit, rooms = packing.BestFit(capacity), []
        for _ in range(300):
            length = rnd.randint(1, capacity)
            bin_id, offset = fit.place(length)
            fits = [r for r in rooms if r >= length]
            if fits:
                assert rooms[bin_id] == min(fits) and offset == capacity - rooms[bin_id]
                rooms[bin_id] -= length
            else:
                assert (bin_id, offset) == (len(rooms), 0)
                rooms.append(capacity - length)


def test_pack_places_every_piece(make_docs):
    rnd = random.Random(9)
    rows = EDGE[:-3] + [(1000 + i, " ".join(rnd.choice(["alpha", "beta", "gamma7"]) for _ in range(rnd.randrange(60))))
                        for i in range(150)]
    got = packing.pack(make_docs(rows), WORDS, capacity=32, group=60).collect()
    pieces, total = {}, 0
    for i, t in rows:
        ids = np.array(whole(WORDS, t) + [0], "<u4")
        total += len(ids)
        for k, lo in enumerate(range(0, len(ids), 32)):
            part = ids[lo:lo + 32]
            key = (i, k, lo, len(part), zlib.crc32(part.tobytes()))
            pieces[key] = pieces.get(key, 0) + 1
    for r in got:
        pieces[(r.doc_id, r.piece, r.start, r.length, r.ids_crc32)] -= 1
    assert not any(pieces.values())
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 32
    assert len(sequences) <= -(-total // 32) + 8
    assert packing.pack(make_docs([]), WORDS).count() == 0
