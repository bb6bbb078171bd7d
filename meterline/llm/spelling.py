"""Spelling variant grouping (operator 11): Bloom-guided neighbourhoods.

Words that differ by one inserted, deleted or replaced code point are near. Every word generates its edits -- each code point
left out, each replaced by a later one of the alphabet -- so that every near pair comes up from one of its two words (an inserted code point is
a deleted one of the other word). An edit is looked up in the blocked Bloom filter of its length; only edits that the filter
knows are written as strings, shuffled and joined with the vocabulary, which removes the false ones. So the many edits that are no
word cost some arithmetic and are never rows.

A word's hash is a polynomial in its code points, so an edit's hash follows from the word's with a few operations, for all
edits of many words of one length at once. Filters of all lengths lie one after another; they go out in broadcasts of at most ``SENT_BYTES``, one pass
over the edits each, so a larger vocabulary takes more passes, not more memory, and the rate of false positives stays.

A word's form is the near word with the most occurrences (ties: the smaller in code-point order) if it has at least twice as many. Forms of forms
are followed by pointer doubling: counts double at each step, so 63 steps, or 6 rounds, are enough for any table.

Null and empty texts have no words. Copies of a text count each time. A null id enters the thinning hash as an empty text. Very long words are
handled in parts. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.llm.common import BATCH_ROWS, column, doc_columns, save, text_bytes

#: Code points that words consist of, once A-Z is lower-cased.
ALPHABET = "".join(map(chr, [*range(0x61, 0x7B), *range(0xC0, 0x100)]))
LEAST_LENGTH, LEAST_COUNT, LEAST_RATIO = 5, 3, 2
HELD = 250_000  # different words that a task holds before it hands its counts on
BITS = 16  # filter bits of a word
PROBES = 7
LONG = 64  # words of this length and longer share a filter
SENT_BYTES = 16 << 20
EDITS = 1 << 20  # edits looked at together
WORDS_A_TASK = 20_000
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)


def word_counts(docs: DataFrame, thin: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(word, n)`` of all runs of letters, A-Z lower-cased.

    With ``thin``, a run loses one code point wherever ``thin`` divides the crc32 of ``<doc_id>:<run>``: the one at that crc32 modulo its length.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, total = re.compile(f"[{ALPHABET[0]}-{ALPHABET[25]}{ALPHABET[26]}-{ALPHABET[-1]}]+"), Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())],
                                              names=["word", "n"])
            total.clear()
            return made

        for batch in batches:
            for doc_id, data in zip(column(batch, "doc_id").to_pylist(), text_bytes(batch)):
                found = runs.findall(data.lower().decode("utf-8", "replace"))
                if not thin:
                    total.update(found)
                    continue
                start = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
                for word, n in Counter(found).items():
                    h = zlib.crc32(word.encode(), start)
                    if h % thin == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                    total[word] += n
            total.pop("", None)
            if len(total) > HELD:
                yield out()
        yield out()

    made = docs.select(*doc_columns(id_col, text_col)).mapInArrow(run, "word string, n long")
    return made.groupBy("word").agg(F.sum("n").alias("n"))


def _powers(n: int) -> np.ndarray:
    p = np.ones(n, dtype=np.uint64)
    if n > 1:
        p[1:] = np.cumprod(np.full(n - 1, _BASE, dtype=np.uint64))
    return p


def _codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row a word."""
    return np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").reshape(len(words), -1).astype(np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shards:
    """Where the filter of each length lies, in blocks of 512 bits."""

    def __init__(self, sizes: dict[int, int]):
        self.blocks = np.zeros(LONG + 1, dtype=np.uint64)
        for length, n in sizes.items():
            self.blocks[min(length, LONG)] += np.uint64(n)
        self.blocks = (self.blocks * np.uint64(BITS) + np.uint64(511)) // np.uint64(512)
        self.first = np.concatenate([[0], np.cumsum(self.blocks)[:-1]]).astype(np.int64)
        self.total = int(self.blocks.sum())

    def place(self, h: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Block of each hash of a word of this length, and the bits that choose its places in it."""
        z, shard = _mixed(h + np.uint64(length)), min(length, LONG)
        block = ((z >> np.uint64(32)) * self.blocks[shard]) >> np.uint64(32)
        return self.first[shard] + block.astype(np.int64), _mixed(z)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str], list[int]]]:
    groups: dict[int, tuple[list[str], list[int]]] = {}
    for word, n in zip(column(batch, "word").to_pylist(), column(batch, "n").to_pylist()):
        words, counts = groups.setdefault(len(word), ([], []))
        words.append(word)
        counts.append(n)
    for length, (words, counts) in sorted(groups.items()):
        yield length, words, counts


def _filter(vocabulary: DataFrame, shards: Shards) -> DataFrame:
    """``(slot, bits)``: the filters of all lengths as longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, words, _ in _by_length(batch):
                h = (_codes(words) * _powers(length)).sum(axis=1, dtype=np.uint64)
                block, z = shards.place(h, length)
                for t in range(PROBES):
                    bit = ((z >> np.uint64(9 * t)) & np.uint64(511)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(block * 8 + (bit >> 6)), pa.array((np.uint64(1) << (bit & 63).astype(np.uint64)).view(np.int64))],
                        names=["slot", "bits"])

    return vocabulary.mapInArrow(run, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits"))


def _edits(codes: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``(length, hash, word, place, sign)`` of the edits of words of one length, some places at a time; sign 0: left out."""
    n, length = codes.shape
    power, back = _powers(length + 1), np.uint64(_BACK)
    terms = codes * power[:length]
    before = np.concatenate([np.zeros((n, 1), dtype=np.uint64), np.cumsum(terms, axis=1, dtype=np.uint64)], axis=1)
    whole = before[:, -1:]
    if length > 1:
        h = before[:, :-1] + (whole - before[:, 1:]) * back
        new = np.ones((n, length), dtype=bool)
        new[:, 1:] = codes[:, 1:] != codes[:, :-1]  # of a run of equal signs, leaving out any gives the same word
        word, place = np.nonzero(new)
        yield length - 1, h[word, place], word, place, np.zeros(len(word), dtype=np.uint64)
    step = max(1, EDITS // (n * len(alphabet)))
    for at in range(0, length, step):
        part = codes[:, at:at + step, None]
        later = alphabet[None, None, :] > part
        h = whole[:, :, None] + (alphabet[None, None, :] - part) * power[at:at + step][None, :part.shape[1], None]
        word, place, sign = np.nonzero(later)
        yield length, h[later], word, place + at, alphabet[sign]


def _known(vocabulary: DataFrame, shards: Shards, bits: np.ndarray, lo: int, hi: int, alphabet: str, least: int) -> DataFrame:
    """``(word, n, edit)``: the edits whose filter block lies in ``lo`` to ``hi`` and has all their bits."""
    sent = vocabulary.sparkSession.sparkContext.broadcast(bits)
    signs = np.array(sorted(set(map(ord, alphabet))), dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        for batch in batches:
            for length, words, counts in _by_length(batch):
                most = max(1, EDITS // (length * len(signs)))
                for at in range(0, len(words), most):
                    some, n = words[at:at + most], counts[at:at + most]
                    for size, h, word, place, sign in _edits(_codes(some), signs):
                        if size < least:
                            continue
                        block, z = shards.place(h, size)
                        left = np.flatnonzero((block >= lo) & (block < hi))
                        block, z = block[left] - lo, z[left]
                        for t in range(PROBES):
                            bit = (z >> np.uint64(9 * t)) & np.uint64(511)
                            slot = block * 8 + (bit >> np.uint64(6)).astype(np.int64)
                            on = (held[slot] >> (bit & np.uint64(63))) & np.uint64(1) == 1
                            left, block, z = left[on], block[on], z[on]
                        if not len(left):
                            continue
                        rows = [(some[w], n[w], some[w][:p] + (chr(s) if s else "") + some[w][p + 1:])
                                for w, p, s in zip(word[left].tolist(), place[left].tolist(), sign[left].tolist())]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()),
                             pa.array([r[2] for r in rows], pa.string())], names=["word", "n", "edit"])

    known = save(vocabulary.mapInArrow(run, "word string, n long, edit string"), "spelling-known")
    sent.destroy()
    return known


def near_pairs(vocabulary: DataFrame, alphabet: str = ALPHABET, least: int = LEAST_LENGTH) -> DataFrame:
    """``(word, near, near_n)``: both ways of every two words of ``vocabulary`` (``word``, ``n``; distinct) that are one edit apart.

    Words consist of the signs of ``alphabet`` and have ``least`` signs or more.
    """
    spark = vocabulary.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    sizes = {r[0]: r[1] for r in vocabulary.groupBy(F.least(F.length("word"), F.lit(LONG)).alias("size")).count().collect()}  # LONG rows at most
    shards, total = Shards(sizes), sum(sizes.values())
    dealt = vocabulary.repartition(max(2 * spark.sparkContext.defaultParallelism, -(-total // WORDS_A_TASK)), "word")
    made, step = save(_filter(vocabulary, shards), "spelling-filter"), SENT_BYTES // 64
    known = []
    for lo in range(0, max(shards.total, 1), step):
        hi = min(lo + step, shards.total)
        bits = np.zeros(max(hi - lo, 1) * 8, dtype=np.uint64)
        part = made.where(F.col("slot").between(lo * 8, hi * 8 - 1)).toArrow()
        bits[part["slot"].to_numpy() - lo * 8] = part["bits"].to_numpy().view(np.uint64)
        known.append(_known(dealt, shards, bits, lo, hi, alphabet, least))
    pairs = reduce(DataFrame.union, known).join(
        vocabulary.select(F.col("word").alias("edit"), F.col("n").alias("edit_n")), "edit")
    return (pairs.select(F.explode(F.array(F.struct("word", F.col("edit").alias("near"), F.col("edit_n").alias("near_n")),
                                           F.struct(F.col("edit").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n"))))
                         .alias("s")).select("s.*"))


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of every row of ``forms`` (``word``, ``form``; a word once, no cycles): the last form that is reached."""
    now = save(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        up = now.select(F.col("word").alias("root"), F.col("root").alias("higher"))
        after = save(now.join(up, "root", "left").select("word", F.coalesce("higher", "root").alias("root"),
                                                         F.col("higher").isNotNull().alias("moved")), "spelling-roots")
        now = after.select("word", "root")
        if not after.where("moved").limit(1).count():
            return now


def variants(counted: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = LEAST_RATIO,
             alphabet: str = ALPHABET) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every word of ``counted`` (``word``, ``n``) that is long and frequent enough."""
    vocabulary = save(counted.where((F.length("word") >= least_length) & (F.col("n") >= least_count)), "spelling-words")
    best = F.min(F.struct((-F.col("near_n")).alias("neg"), F.col("near").alias("word")))
    near = near_pairs(vocabulary, alphabet, least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    form_n = -F.col("best.neg")
    taken = form_n >= ratio * F.col("n")
    rows = save(vocabulary.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(taken, F.col("best.word")).alias("form"), F.when(taken, form_n).alias("form_n")), "spelling-forms")
    last = roots(rows.where("form is not null"))
    return rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
