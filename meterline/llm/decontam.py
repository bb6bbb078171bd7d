"""Benchmark decontamination (operator 2): SimHash over item-sized windows.

For every number of words that a benchmark item has, windows of that many words are taken at
every place of every text. A window is fingerprinted unless a count of benchmark shingles
in it already rules the similarity out (an upper bound, so nothing that could pass is
lost). Its fingerprint meets the fingerprints of the items of that size in a multi-index of Hamming blocks: with ``BLOCKS``
blocks, any fingerprint within ``RADIUS`` bits differs by at most ``RADIUS // BLOCKS`` bits in some block, and
all block values that near are looked up. Candidates within the radius are verified with the exact weighted
Jaccard similarity of their shingles (a shingle weighs as often as it occurs).

The benchmark is read by every task. Its size is checked first: it goes out in blocks of at most
``BLOCK_BYTES`` of text, one pass over the documents for each, so no broadcast exceeds that bound.
"""

from __future__ import annotations

from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.llm.common import column, doc_columns, map_texts, save, text_bytes, text_key, without

SHINGLE = 5
SIMILARITY = 0.8
RADIUS, BLOCKS = 19, 10
BLOCK_BYTES = 16 << 20
_FILTER_BITS = 22
STEP = 4096  # shingles whose bits are held at once
# Words are runs of letters and digits in lower case: other ASCII signs part them.
_WORDS = bytes((c + 32 if 65 <= c <= 90 else c) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32
               for c in range(256))
_STEP = np.uint64(0x9E3779B97F4A7C15)


_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_SLICE = 1 << 20
_powers: list[np.ndarray] = []


def plain(data: bytes) -> bytes:
    """A text in lower case with a space for every sign that parts words."""
    if not data.isascii():
        data = data.decode("utf-8", "replace").lower().encode()
    return data.translate(_WORDS)


def words_of(data: bytes) -> list[bytes]:
    return plain(data).split()


def _hash_slice(data: bytes) -> np.ndarray:
    n = len(data)
    if not _powers or len(_powers[0]) < n:
        size = max(n, _SLICE)
        _powers[:] = [np.cumprod(np.append(np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)), dtype=np.uint64)
                      for x in (_BASE, pow(_BASE, -1, 1 << 64))]
    signs = np.frombuffer(data, dtype=np.uint8)
    inside = np.zeros(n + 2, dtype=bool)
    np.not_equal(signs, 32, out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[0::2], edges[1::2]
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(signs * _powers[0][:n], out=sums[1:])
    out = (sums[ends] - sums[starts]) * _powers[1][starts]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(29))


def hash_words(data: bytes) -> np.ndarray:
    """Hashes of the words of a ``plain`` text: a polynomial over a word's bytes, from one running sum over the text.

    Long texts are taken in slices that end between words, so the sums stay small.
    """
    if len(data) <= _SLICE:
        return _hash_slice(data) if data else np.empty(0, dtype=np.uint64)
    parts, at = [], 0
    while at < len(data):
        end = data.find(b" ", at + _SLICE)
        end = len(data) if end < 0 else end
        parts.append(_hash_slice(data[at:end]))
        at = end
    return np.concatenate(parts)


def shingle_hashes(hashed: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` words from the words' hashes."""
    n = len(hashed) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = hashed[:n].copy()
    for j in range(1, k):
        out = out * _STEP + hashed[j:j + n]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of the values are in the sorted, non-empty ``known``."""
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _bits(shingles: np.ndarray) -> np.ndarray:
    return np.unpackbits(shingles.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def simhash(shingles: np.ndarray) -> int:
    """64-bit fingerprint: a bit is set if it is set in over half of the shingle hashes."""
    ones = sum(_bits(shingles[at:at + STEP]).sum(axis=0, dtype=np.int64) for at in range(0, len(shingles), STEP))
    return int(np.packbits(ones * 2 > len(shingles), bitorder="little").view("<u8")[0])


def similarity(a: list[bytes], b: list[bytes], k: int) -> float:
    """Exact weighted Jaccard similarity of two word runs over their ``k``-word shingles."""
    x, y = (Counter(zip(*(w[i:] for i in range(k)))) for w in (a, b))
    both = sum(min(n, y[s]) for s, n in x.items() if s in y)
    return both / max(1, sum(x.values()) + sum(y.values()) - both)


class Index:
    """Multi-index of the items of one benchmark block, by number of words."""

    def __init__(self, items: list[tuple], shingle: int, threshold: float, radius: int, blocks: int):
        self.shingle, self.threshold, self.radius = shingle, threshold, radius
        edges = [64 * i // blocks for i in range(blocks + 1)]
        self.parts = [(lo, (1 << (hi - lo)) - 1,
                       [sum(1 << b for b in c) for n in range(radius // blocks + 1) for c in combinations(range(hi - lo), n)])
                      for lo, hi in zip(edges, edges[1:])]
        self.sizes: dict[int, dict] = {}
        for item_id, data in items:
            words = words_of(data)
            if not words:
                continue
            k = min(shingle, len(words))
            shingles = shingle_hashes(hash_words(plain(data)), k)
            at = self.sizes.setdefault(len(words), {"k": k, "items": [], "seen": [], "blocks": {}})
            mark = simhash(shingles)
            for p, (lo, mask, _) in enumerate(self.parts):
                at["blocks"].setdefault((p, mark >> lo & mask), []).append(len(at["items"]))
            at["items"].append((item_id, words, mark))
            at["seen"].append(shingles)
        self.filters: dict[int, np.ndarray] = {}  # per shingle length: which low bits any item shingle has
        self.known: dict[int, np.ndarray] = {}
        for size, at in self.sizes.items():
            at["seen"] = np.unique(np.concatenate(at["seen"]))
            n = size - at["k"] + 1
            # similarity s of two n-shingle runs needs 2s/(1+s) n shared shingles
            at["least"] = max(1, int(np.ceil(2 * threshold / (1 + threshold) * n - 1e-9)))
            seen = [at["seen"]] + ([self.known[at["k"]]] if at["k"] in self.known else [])
            self.known[at["k"]] = np.unique(np.concatenate(seen))
        low = np.uint64((1 << _FILTER_BITS) - 1)
        for k, known in self.known.items():
            self.filters[k] = np.zeros(1 << _FILTER_BITS, dtype=bool)
            self.filters[k][(known & low).astype(np.int64)] = True

    def _near(self, at: dict, mark: int) -> set[int]:
        found: set[int] = set()
        for p, (lo, mask, flips) in enumerate(self.parts):
            value = mark >> lo & mask
            for x in flips:
                found.update(at["blocks"].get((p, value ^ x), ()))
        return {i for i in found if (at["items"][i][2] ^ mark).bit_count() <= self.radius}

    def matches(self, data: bytes) -> list[tuple]:
        """``(item_id, start word, words, similarity, distance)``: the best window of each run of overlapping hits."""
        data = plain(data)
        hashed = hash_words(data)
        words: list[bytes] = []
        low, found = np.uint64((1 << _FILTER_BITS) - 1), []
        for k, known in self.known.items():
            shingles = shingle_hashes(hashed, k)
            maybe = np.flatnonzero(self.filters[k][(shingles & low).astype(np.int64)])
            maybe = maybe[among(shingles[maybe], known)]
            if not len(maybe):
                continue
            words = words or data.split()
            for size, at in self.sizes.items():
                n = size - at["k"] + 1
                if at["k"] != k or len(words) < size or len(maybe) < at["least"]:
                    continue
                hits = maybe[among(shingles[maybe], at["seen"])]
                if len(hits) < at["least"]:
                    continue
                best: dict = {}
                for start, mark in self._windows(shingles, hits, at["least"], n, len(words) - size):
                    for i in self._near(at, mark):
                        item_id, item, item_mark = at["items"][i]
                        s = similarity(words[start:start + size], item, k)
                        if s < self.threshold:
                            continue
                        row = (item_id, start, size, s, (item_mark ^ mark).bit_count())
                        runs = best.setdefault(i, [])
                        if runs and start < runs[-1][1] + size:
                            runs[-1] = max(runs[-1], row, key=lambda r: (r[3], -r[1]))
                        else:
                            runs.append(row)
                found += [r for runs in best.values() for r in runs]
            found += self._whole(words, shingles, maybe, k)
        return found

    def _whole(self, words: list[bytes], shingles: np.ndarray, maybe: np.ndarray, k: int) -> list[tuple]:
        """A text with fewer words than an item, as one window of all its words."""
        found, n = [], len(words) - k + 1
        for size, at in self.sizes.items():
            # n shingles are at most n / (size - k + 1) similar to those of the item
            if at["k"] != k or size <= len(words) or n < self.threshold * (size - k + 1):
                continue
            both = self.threshold / (1 + self.threshold) * (n + size - k + 1)
            if among(shingles[maybe], at["seen"]).sum() < both - 1e-9:
                continue
            mark = simhash(shingles)
            for i in self._near(at, mark):
                item_id, item, item_mark = at["items"][i]
                s = similarity(words, item, k)
                if s >= self.threshold:
                    found.append((item_id, 0, len(words), s, (item_mark ^ mark).bit_count()))
        return found

    @staticmethod
    def _windows(shingles: np.ndarray, hits: np.ndarray, least: int, n: int, last: int):
        """``(start, fingerprint)`` of every window of ``n`` shingles, up to start ``last``, that holds ``least`` hits.

        Only ranges of such starts are kept, and the bits of ``STEP`` shingles at a time, so memory does not grow with the item's length
        times the hits.
        """
        ahead = hits[least - 1:] - hits[:len(hits) - least + 1] < n
        lows = np.maximum(hits[least - 1:][ahead] - n + 1, 0)
        highs = np.minimum(hits[:len(hits) - least + 1][ahead], last)
        at = 0
        for lo, hi in zip(lows.tolist(), highs.tolist()):
            lo = max(lo, at)
            if lo > hi:
                continue
            at = hi + 1
            ones = sum(_bits(shingles[j:min(j + STEP, lo + n)]).sum(axis=0, dtype=np.int64) for j in range(lo, lo + n, STEP))
            for j in range(lo, hi + 1, STEP):
                stop = min(j + STEP, hi + 1)
                moved = np.zeros((stop - j, 64), dtype=np.int64)
                moved[1:] = np.cumsum(_bits(shingles[j + n:stop + n - 1]).astype(np.int64) - _bits(shingles[j:stop - 1]), axis=0)
                marks = np.packbits((ones + moved) * 2 > n, axis=1, bitorder="little").view("<u8").ravel()
                yield from zip(range(j, stop), map(int, marks))
                if stop <= hi:
                    ones = ones + moved[-1] + _bits(shingles[stop + n - 1:stop + n])[0].astype(np.int64) - _bits(shingles[stop - 1:stop])[0]


def matches(docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, threshold: float = SIMILARITY,
            radius: int = RADIUS, blocks: int = BLOCKS, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id",
            text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
            carry: list | tuple = ()) -> DataFrame:
    """``(doc_id, *carry, item_id, start_word, n_words, similarity, distance)``: one row per passage of an item in a text.

    A text with fewer words than an item is compared with it as a whole. Items of fewer words than a shingle are one shingle; items and texts without words (null, empty, signs
    only) match nothing. Overlapping windows of an item give one row, the most similar (the first of equals). Repeated
    rows give their rows each, repeated items count once; null ids are kept; an empty table on either side
    gives no rows. Very long texts are searched whole; columns other than ``carry`` are not read, whatever their names.
    """
    items = benchmark.select(F.col(item_id_col).cast("long").alias("item_id"),
                             F.col(item_text_col).cast("string").alias("text")).where("text IS NOT NULL").distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    passes = max(1, -(-2 * total // block_bytes)) if total > block_bytes else 1
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(passes))
    kept = [F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)]
    names = [f"carry_{i}" for i in range(len(carry))]
    schema = ", ".join(["doc_id long", *[f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, carry)],
                        "item_id long, start_word long, n_words long, similarity double, distance int"])
    spark = docs.sparkSession

    def one_pass(k: int) -> DataFrame:
        block = [(r[0], r[1].encode("utf-8", "replace")) for r in items.where(part == k).collect()]  # <= block_bytes
        sent = spark.sparkContext.broadcast(block)
        held: list[Index] = []

        def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            if not held:
                held.append(Index(sent.value, shingle, threshold, radius, blocks))
            at, rows = [], []
            for i, data in enumerate(text_bytes(batch)):
                for row in held[0].matches(data):
                    at.append(i)
                    rows.append(row)
            if not rows:
                return None
            where = pa.array(at, pa.int64())
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32()]
            return pa.RecordBatch.from_arrays(
                [*[column(batch, c).take(where) for c in ("doc_id", *names)],
                 *[pa.array(c, t) for c, t in zip(zip(*rows), kinds)]],
                names=["doc_id", *names, "item_id", "start_word", "n_words", "similarity", "distance"])

        return map_texts(docs, doc_columns(id_col, text_col) + kept, schema, run)

    found = one_pass(0)
    for k in range(1, passes):
        found = found.union(one_pass(k))
    return found.withColumnsRenamed(dict(zip(names, carry)))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that hold a passage of a benchmark item, all columns kept."""
    marked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), text_key(text_col).alias("h"))
    found = matches(marked, benchmark, carry=["h"], **options).select("doc_id", "h").distinct()
    return without(docs, save(found, "contaminated"), id_col, text_col)
