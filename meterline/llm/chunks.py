"""Substring dedup (operator 10): content-defined chunking with a gear rolling hash.

A text is a sequence of words. A gear hash rolls over them, ``hash = (hash << 16) + gear(word)``
in 64 bits, so it depends on the last four words only; a chunk ends where the finished hash falls on one
value in ``AVERAGE``. Chunk ends follow the content: words put in before a passage move no
boundary inside it beyond the first four words. Equal chunks are found by 64-bit digest. The first occurrence (least doc_id,
then place) stays; later ones are duplicates, and runs of neighbouring duplicate chunks of at least ``MIN_WORDS`` words are
the repeated passages.

Each text settles what it repeats itself. Digests are then looked at as two longs each, combined map-side; those
that occur in two documents are written out and joined to their places, both sides as plain exchanges that Spark may
split, so a passage that a third of all texts share is no task's group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterline.llm.common import column, doc_columns, if_small, map_texts, save, text_bytes

AVERAGE = 5
LONGEST = 64  # words after which a chunk ends in any case
MIN_WORDS = 16


def cuts(gears: np.ndarray, average: int = AVERAGE, longest: int = LONGEST) -> np.ndarray:
    """End positions (exclusive) of the chunks of a word sequence from its words' 64-bit gear values."""
    n = len(gears)
    if not n:
        return np.empty(0, dtype=np.int64)
    rolled = gears.copy()
    for back in range(1, min(4, n)):
        rolled[back:] += gears[:-back] << np.uint64(16 * back)
    rolled ^= rolled >> np.uint64(31)
    rolled *= np.uint64(0x9E3779B97F4A7C15)
    rolled ^= rolled >> np.uint64(29)
    ends = np.flatnonzero(rolled % np.uint64(average) == 0) + 1
    ends = np.concatenate([ends, [n]]) if not len(ends) or ends[-1] != n else ends
    starts = np.concatenate([[0], ends[:-1]])
    if (ends - starts).max() > longest:
        ends = np.concatenate([np.append(np.arange(a + longest, b, longest), b) for a, b in zip(starts, ends)])
    return ends


def chunk(data: bytes, average: int = AVERAGE, longest: int = LONGEST) -> tuple[list[int], np.ndarray]:
    """``(digests, ends)``: the chunks of a text; words are runs without white space."""
    words = data.split()
    ends = cuts(np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words)), average, longest)
    digest, lo, digests = xxhash.xxh3_64_intdigest, 0, []
    for hi in ends.tolist():
        digests.append(digest(b" ".join(words[lo:hi])))
        lo = hi
    return digests, ends


def chunked(docs: DataFrame, average: int = AVERAGE, longest: int = LONGEST, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """``(doc_id, h, fresh, again)``: one row per text; ``h`` tells texts of one id apart.

    ``fresh`` are the chunks that stand in the text for the first time (digest, place, start and end word),
    ``again`` those that the text itself repeats (place, start, end).
    """

    def spots(picked: list, names: list[str]) -> pa.Array:
        ends = np.cumsum([0, *map(len, picked)])
        flat = [row for rows in picked for row in rows]
        cols = list(zip(*flat)) or [()] * len(names)
        arrays = [pa.array(np.array(c, dtype=np.uint64).view(np.int64)) if n == "digest" else pa.array(c, pa.int32())
                  for n, c in zip(names, cols)]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(arrays, names))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        marks, fresh, again = [], [], []
        for data in text_bytes(batch):
            digests, ends = chunk(data, average, longest)
            marks.append(xxhash.xxh3_64_intdigest(data))
            seen: set[int] = set()
            new, old, lo = [], [], 0
            for place, (digest, hi) in enumerate(zip(digests, ends.tolist())):
                if digest in seen:
                    old.append((place, lo, hi))
                else:
                    seen.add(digest)
                    new.append((digest, place, lo, hi))
                lo = hi
            fresh.append(new)
            again.append(old)
        return pa.RecordBatch.from_arrays(
            [column(batch, "doc_id"), pa.array(np.array(marks, dtype=np.uint64).view(np.int64)),
             spots(fresh, ["digest", "place", "start", "end"]), spots(again, ["place", "start", "end"])],
            names=["doc_id", "h", "fresh", "again"])

    spot = "place:int,start:int,end:int"
    return map_texts(docs, doc_columns(id_col, text_col), f"doc_id long, h long, fresh array<struct<digest:bigint,{spot}>>, "
                                                          f"again array<struct<{spot}>>", run)


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, average: int = AVERAGE, longest: int = LONGEST,
            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, h, start_word, n_words, n_chunks, first_doc_id)``: one row per repeated passage.

    The passage stands earlier as well: its first chunk first in ``first_doc_id`` (its own text where that repeats
    itself). Texts are ordered by id; different texts without an id, or with an id that other texts have too, are different
    documents and come first, in an order of their own (``first_doc_id`` is null for a text without an id). Rows equal in id and text are one document. Null and
    empty texts have no chunks. Runs of fewer than ``min_words`` words are no passages. Very long texts are cut like any other; other columns
    are not read. Empty input gives no rows.
    """
    table = save(chunked(docs, average, longest, id_col, text_col), "chunks")
    shared = save(table.groupBy("doc_id").agg(F.min("h").alias("a"), F.max("h").alias("z"))
                  .where("doc_id IS NULL OR a < z").select(F.col("doc_id").alias("d")), "chunks-shared-ids")
    if shared.limit(1).count():
        # such a text goes by its digest, a number below all ids (which are 0 or more)
        odd = table.join(if_small(shared), F.col("doc_id").eqNullSafe(F.col("d")), "left_semi").select("doc_id", "h").distinct()
        odd = save(odd.withColumn("owner", -2 - F.shiftrightunsigned(F.xxhash64("doc_id", "h"), 2)), "chunks-shared")
        marked = table.join(if_small(odd.select(F.col("doc_id").alias("d"), F.col("h").alias("g"), F.col("owner").alias("o"))),
                            F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")), "left")
        table = save(marked.select("doc_id", "h", "fresh", "again", F.coalesce("o", "doc_id").alias("owner")), "chunks-owned")
    else:
        odd, table = None, table.withColumn("owner", F.col("doc_id"))
    # two longs a chunk: a passage's digests collapse to one row a task before the shuffle
    twice = save(table.select("owner", F.explode("fresh.digest").alias("digest")).groupBy("digest")
                 .agg(F.min("owner").alias("first"), F.max("owner").alias("last")).where("first < last")
                 .select("digest", "first"), "chunks-twice")
    fresh = table.select("doc_id", "h", "owner", F.inline("fresh")).select("doc_id", "h", "digest", "place", "start", "end", "owner")
    later = (fresh.join(twice, "digest").where("owner > first")
             .select("doc_id", "h", "place", "start", "end", "first")
             .union(table.select("doc_id", "h", "owner", F.inline("again")).select("doc_id", "h", "place", "start", "end", "owner"))
             .distinct())
    order = Window.partitionBy("doc_id", "h").orderBy("place")
    runs = later.withColumn("run", F.col("place") - F.row_number().over(order))
    found = (runs.groupBy("doc_id", "h", "run")
            .agg(F.min("start").cast("long").alias("start_word"),
                 (F.max("end") - F.min("start")).cast("long").alias("n_words"),
                 F.count(F.lit(1)).alias("n_chunks"), F.min_by("first", "place").alias("first_doc_id"))
            .where(F.col("n_words") >= min_words).drop("run"))
    if odd is None:
        return found
    named = if_small(odd.select(F.col("doc_id").alias("named"), "owner"))
    return found.join(named, F.col("first_doc_id") == F.col("owner"), "left").select(
        "doc_id", "h", "start_word", "n_words", "n_chunks",
        F.when(F.col("owner").isNull(), F.col("first_doc_id")).otherwise(F.col("named")).alias("first_doc_id"))


def without_repeats(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text)`` with the repeated passages cut out, white space elsewhere as it was."""
    import re
    word = re.compile(rb"[^\x20\x09-\x0D]+")

    def mark(batch: pa.RecordBatch) -> pa.RecordBatch:
        marks = [xxhash.xxh3_64_intdigest(t) for t in text_bytes(batch)]
        return pa.RecordBatch.from_arrays(
            [column(batch, "doc_id"), column(batch, "text"), pa.array(np.array(marks, dtype=np.uint64).view(np.int64))],
            names=["doc_id", "text", "h"])

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for data, spans in zip(text_bytes(batch), column(batch, "spans").to_pylist()):
            if spans:
                places = [m.span() for m in word.finditer(data)]
                kept, at = [], 0
                for s in sorted(spans, key=lambda s: s["start_word"]):
                    kept.append(data[at:places[s["start_word"]][0]])
                    at = places[s["start_word"] + s["n_words"] - 1][1]
                data = b"".join([*kept, data[at:]])
            out.append(data.decode("utf-8", "replace"))
        return pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(out)], names=["doc_id", "text"])

    marked = map_texts(docs, doc_columns(id_col, text_col), "doc_id long, text string, h long", mark)
    spans = found.groupBy(F.col("doc_id").alias("d"), F.col("h").alias("g")).agg(
        F.collect_list(F.struct("start_word", "n_words")).alias("spans"))
    joined = marked.join(spans, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")), "left")
    return map_texts(joined, ["doc_id", "text", "spans"], "doc_id long, text string", cut)
