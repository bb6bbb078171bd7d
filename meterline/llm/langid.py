"""Language ID (operator 7): segmentation-marginalised unigrams over a fixed public vocabulary.

A language is a probability for every piece of a public subword vocabulary. They are learned
from all labelled texts: every task counts its words per language, cuts each different word
once with the vocabulary's own segmenter and adds the pieces up, so only (language, piece, count) rows are shuffled.

A text's probability in a language is the product over its words; a word's probability is the sum
over all its segmentations into pieces (forward algorithm), for all languages at once.
The model has one number per piece and language. It goes out for ``LANGUAGES`` languages at a time, one pass over the texts each, so neither it nor what
is kept of words seen before grows with the documents or the labels; the passes' results are compared row by row.

A word is a run of letters with their combining marks. Words of any length are scored whole: the forward sums of a long one need no more memory than the longest
piece.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.llm.common import BATCH_ROWS, column, doc_columns, map_texts, save, text_key, texts

LANGUAGES = 200  # of one pass; the vocabulary's 32,000 pieces then take 51 MB
SMOOTH = 0.1
UNKNOWN = 1e-7  # probability of a single sign that the vocabulary lacks, alike in all languages
LONGEST = 32  # longer words are scored one by one and not kept
HELD_NUMBERS = 16_000_000  # scores of words that a worker keeps: words times languages
WORD_CACHE = 1_000_000


def _marks() -> str:
    """Combining marks as ranges of a character class."""
    points = [i for i in range(0x300, 0x20000) if unicodedata.category(chr(i))[0] == "M"]
    first = [p for i, p in enumerate(points) if not i or points[i - 1] != p - 1]
    last = [p for i, p in enumerate(points) if i + 1 == len(points) or points[i + 1] != p + 1]
    return "".join(f"{chr(a)}-{chr(z)}" for a, z in zip(first, last))


_WORD = re.compile(rf"(?:[^\W\d_]+[{_marks()}]*)+")
_PLAIN = re.compile(r"[^\W\d_]+")
_BELOW_MARKS = bytes(range(0xCC))  # no UTF-8 form of a combining mark (U+0300 and above) consists of these alone
_MARK = "▁"  # word start, as the vocabulary writes it


def words_of(text: str) -> list[str]:
    """Runs of letters with their combining marks, in small letters; most texts hold no mark and take the plainer search."""
    small = text.lower()
    if small.isascii() or not small.encode("utf-8", "replace").translate(None, _BELOW_MARKS):
        return _PLAIN.findall(small)
    return _WORD.findall(small)


def vocabulary(path: str) -> list[str]:
    """Pieces of a sentencepiece file that hold text, lower-case; control, unknown and byte pieces are left out."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    skip = [sp.is_control, sp.is_unknown, sp.is_byte, sp.is_unused]
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size())
            if not any(f(i) for f in skip) and sp.id_to_piece(i) == sp.id_to_piece(i).lower()]


def piece_counts(docs: DataFrame, vocab_path: str, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``(lang, piece, n)``: pieces of all words of all labelled texts (null labels and texts teach nothing)."""
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=vocab_path)
        seen: dict[str, Counter] = {}
        total: dict[str, Counter] = {}

        def settle() -> None:
            for lang, counted in seen.items():
                into = total.setdefault(lang, Counter())
                for pieces, n in zip(sp.encode(list(counted), out_type=str, num_threads=1), counted.values()):
                    for piece in pieces:
                        into[piece] += n
            seen.clear()

        for batch in batches:
            for lang, text in zip(column(batch, "lang").to_pylist(), texts(batch)):
                seen.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, seen.values())) > WORD_CACHE // 4:
                settle()
        settle()
        rows = [(lang, piece, n) for lang, counted in total.items() for piece, n in counted.items()]
        for at in range(0, len(rows), 10_000):
            langs, pieces, ns = zip(*rows[at:at + 10_000])
            yield pa.RecordBatch.from_arrays([pa.array(langs), pa.array(pieces), pa.array(ns, pa.int64())],
                                             names=["lang", "piece", "n"])

    return (labelled.mapInArrow(run, "lang string, piece string, n long")
            .groupBy("lang", "piece").agg(F.sum("n").alias("n")))


class Model:
    """Piece probabilities per language and the forward algorithm over words."""

    def __init__(self, langs: list[str], pieces: list[str], probability: np.ndarray):
        self.langs, self.probability = langs, probability  # (pieces + 2, languages): unknown sign, no piece last
        self.index = {p: i for i, p in enumerate(pieces)}
        self.longest = max(map(len, pieces), default=1)
        self.rows: dict[str, int] = {}
        self.scores = np.empty((0, len(langs)))

    @classmethod
    def learn(cls, counts: list[tuple], pieces: list[str]) -> "Model":
        """From ``(language, piece, count)`` rows."""
        langs = sorted({c[0] for c in counts})
        index, at = {p: i for i, p in enumerate(pieces)}, {c: i for i, c in enumerate(langs)}
        known = [c for c in counts if c[1] in index]
        return cls.of(langs, pieces, np.array([at[c[0]] for c in known], dtype=np.int64),
                      np.array([index[c[1]] for c in known], dtype=np.int64), np.array([c[2] for c in known], dtype=float))

    @classmethod
    def of(cls, langs: list[str], pieces: list[str], lang: np.ndarray, piece: np.ndarray, n: np.ndarray) -> "Model":
        table = np.full((len(pieces) + 2, len(langs)), SMOOTH)
        np.add.at(table, (piece, lang), n)
        table[-2:] = 0
        table /= np.maximum(table.sum(axis=0), 1e-300)
        table[-2] = UNKNOWN
        return cls(langs, pieces, table)

    def _forward_one(self, word: str) -> np.ndarray:
        """Log probabilities of one word of any length; only the last sums that a piece can reach are kept."""
        get, span, unknown = self.index.get, self.longest, len(self.probability) - 2
        sums, scale = np.zeros((span, len(self.langs))), 0.0  # sums[j % span] are those up to place j
        sums[0] = 1.0
        for j in range(1, len(word) + 1):
            now = np.zeros(len(self.langs))
            for i in range(max(0, j - span), j):
                at = get(word[i:j])
                if at is None and i == j - 1:
                    at = unknown
                if at is not None:
                    now += sums[i % span] * self.probability[at]
            sums[j % span] = now
            if j % 8 == 0:  # keep far from underflow
                top = sums.max()
                scale += np.log(top)
                sums /= top
        return np.log(np.maximum(sums[len(word) % span], 1e-300)) + scale

    def _forward(self, words: list[str]) -> np.ndarray:
        """Log probabilities of words of one length: ``alpha[j] = sum over i of alpha[i] * P(piece from i to j)``."""
        n = len(words[0])
        alpha = np.zeros((n + 1, len(words), len(self.langs)))
        alpha[0] = 1.0
        scale = np.zeros((len(words), 1))
        get, none, unknown = self.index.get, len(self.probability) - 1, len(self.probability) - 2
        for j in range(1, n + 1):
            for i in range(max(0, j - self.longest), j):
                ids = np.array([get(w[i:j], none) for w in words])
                if i == j - 1:
                    ids[ids == none] = unknown
                elif (ids == none).all():
                    continue
                alpha[j] += alpha[i] * self.probability[ids]
            if j % 8 == 0:  # keep far from underflow
                top = alpha[max(0, j - self.longest):j + 1].max(axis=(0, 2))[:, None]
                scale += np.log(top)
                alpha[max(0, j - self.longest):j + 1] /= top
        return np.log(np.maximum(alpha[n], 1e-300)) + scale

    def _learn(self, new: list[str]) -> None:
        by_length: dict[int, list[str]] = {}
        for w in new:
            by_length.setdefault(len(w), []).append(w)
        made = []
        for words in by_length.values():
            for at in range(0, len(words), 4096):
                part = words[at:at + 4096]
                made.append(self._forward([_MARK + w for w in part]))
                for w in part:
                    self.rows[w] = len(self.rows)
        used = len(self.rows) - len(new)
        made = np.concatenate(made)
        if used + len(made) > len(self.scores):
            grown = np.empty((max(2 * len(self.scores), used + len(made)), len(self.langs)))
            grown[:used] = self.scores[:used]
            self.scores = grown
        self.scores[used:used + len(made)] = made

    def totals(self, texts: list[str]) -> list[np.ndarray | None]:
        """Log probability of each text in every language; None where it has no letter."""
        if len(self.rows) > min(WORD_CACHE, HELD_NUMBERS // max(1, len(self.langs))):
            self.rows.clear()
        cut = [words if any(any(map(str.isalpha, w)) for w in words) else [] for words in map(words_of, texts)]
        new = sorted(w for w in set().union(*cut).difference(self.rows) if len(w) <= LONGEST)
        if new and self.langs:
            self._learn(new)
        out = []
        for words in cut:
            if not words:
                out.append(None)
                continue
            total = np.zeros(len(self.langs))
            if self.langs:
                short = words if max(map(len, words)) <= LONGEST else [w for w in words if len(w) <= LONGEST]
                total += self.scores[np.fromiter(map(self.rows.__getitem__, short), dtype=np.int64, count=len(short))].sum(axis=0)
                for w in words if len(short) < len(words) else []:
                    if len(w) > LONGEST:
                        total += self._forward_one(_MARK + w)
            out.append(total)
        return out

    def best(self, texts: list[str]) -> list[tuple[str | None, float, float]]:
        """``(language, log probability, log of the sum over all languages)`` of each text; nulls where it has no letter or nothing was learned."""
        out = []
        for total in self.totals(texts):
            if total is None or not self.langs:
                out.append((None, None, None))
                continue
            at = int(total.argmax())
            out.append((self.langs[at], float(total[at]), float(total[at] + np.log(np.exp(total - total[at]).sum()))))
        return out

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """``(language, posterior)`` of each text; ``und`` and 0 where a text has no letter or nothing was learned."""
        return [("und", 0.0) if lang is None else (lang, float(np.exp(top - whole))) for lang, top, whole in self.best(texts)]


def learn(docs: DataFrame, vocab_path: str, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, list[str], int]:
    """The model's parts ``(counts, pieces, blocks)``; ``counts`` is a written table ``(block, lang, at, n)``, ``at`` the place of a piece."""
    pieces = vocabulary(vocab_path)
    spark = docs.sparkSession
    known = spark.createDataFrame(list(zip(pieces, range(len(pieces)))), "piece string, at int")
    counts = save(piece_counts(docs, vocab_path, lang_col, text_col).join(F.broadcast(known), "piece", "left"), "piece-counts")
    names = counts.select("lang").distinct()
    blocks = -(-names.count() // LANGUAGES)
    # languages that were seen with unknown pieces only stay in the model
    blocks = 2 * blocks if blocks > 1 else 1  # dealt by hash: half full on average
    rows = counts.groupBy("lang", "at").agg(F.sum("n").alias("n")).withColumn("block", F.pmod(F.xxhash64("lang"), F.lit(blocks)).cast("int"))
    return save(rows.select("block", "lang", "at", "n"), "language-model"), pieces, blocks


_HELD: dict[str, Model] = {}


def predict(docs: DataFrame, parts: tuple[DataFrame, list[str], int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score)``: one row per input row, from the text alone.

    Null texts and texts without a letter are ``und`` with score 0, and so are all texts if nothing was learned. Repeated rows and null ids
    are kept; other columns are never read, whatever their names; empty input gives no rows. Very long texts and words are scored whole. Equal scores go to the
    first language by name.
    """
    counts, pieces, blocks = parts
    spark = docs.sparkSession

    def one_pass(block: int) -> DataFrame:
        found = counts.where(F.col("block") == block).toArrow()  # at most pieces x the languages of a block
        langs = sorted(set(found["lang"].to_pylist()))
        at = {c: i for i, c in enumerate(langs)}
        lang = np.array([at[c] for c in found["lang"].to_pylist()], dtype=np.int64)
        piece, n = found["at"].to_numpy(), found["n"].to_numpy().astype(float)
        seen = ~np.isnan(piece.astype(float))
        sent = spark.sparkContext.broadcast((langs, pieces, lang[seen], piece[seen].astype(np.int64), n[seen]))
        key = uuid.uuid4().hex

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            if key not in _HELD:
                _HELD.clear()
                _HELD[key] = Model.of(*sent.value)
            langs, tops, wholes = zip(*_HELD[key].best(texts(batch)))
            return pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "h"), pa.array(langs, pa.string()),
                                               pa.array(tops, pa.float64()), pa.array(wholes, pa.float64())],
                                              names=["doc_id", "h", "lang", "top", "whole"])

        return map_texts(docs, [*doc_columns(id_col, text_col), text_key(text_col).alias("h")],
                         "doc_id long, h long, lang string, top double, whole double", run)

    if blocks == 1:
        rows = one_pass(0).withColumn("score", F.exp(F.col("top") - F.col("whole")))
    else:
        # equal rows have equal results in each pass: one of them stands for all, and their number is put back
        passes = [save(one_pass(b).withColumn("pass", F.lit(b)), "language-pass") for b in range(blocks)]
        every = reduce(DataFrame.union, passes)
        high = every.groupBy("doc_id", "h").agg(
            F.count_if(F.col("pass") == 0).alias("copies"), F.max("whole").alias("most"),
            F.min(F.when(F.col("lang").isNotNull(), F.struct((-F.col("top")).alias("neg"), "lang"))).alias("best"),
            F.collect_set(F.struct("pass", "whole")).alias("wholes"))
        total = F.aggregate("wholes", F.lit(0.0), lambda a, x: a + F.coalesce(F.exp(x["whole"] - F.col("most")), F.lit(0.0)))
        rows = (high.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
                .select("doc_id", F.col("best.lang").alias("lang"), F.exp(-F.col("best.neg") - F.col("most") - F.log(total)).alias("score")))
    return rows.select("doc_id", F.coalesce("lang", F.lit("und")).alias("lang_pred"), F.coalesce("score", F.lit(0.0)).alias("score"))


def held_out(id_col: str = "doc_id", folds: int = 5):
    """Whether a row is in the fold that nothing is learned from; null ids are not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))
