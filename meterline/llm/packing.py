"""Best-fit packing (operator 8): best-fit decreasing with a segment tree over remaining capacities.

Only documents longer than a sequence are cut. Full pieces are sequences as they are; all
others are dealt evenly into groups of bounded size, one task each, and every group is
packed by itself: longest piece first, into the open sequence that it fills
tightest. A group leaves a few unfilled sequences at most, whatever its size, so the number of
sequences does not depend on how many machines share the work.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.llm import tokens
from meterline.llm.common import column, doc_columns, map_texts, save, texts

CAPACITY = 2048
# Pieces per packing group: bounds a task's memory (a few numbers per piece), not the result.
GROUP = 200_000
END_ID = 0


class BestFit:
    """Open bins by remaining capacity; the tightest that takes a length is found in O(log capacity)."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.leaves = 1 << capacity.bit_length()  # leaf c: bins with c places left
        self.open = np.zeros(2 * self.leaves, dtype=np.int64).tolist()  # node: open bins below it
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.made = 0

    def _count(self, room: int, by: int) -> None:
        node = self.leaves + room
        while node:
            self.open[node] += by
            node >>= 1

    def _tightest(self, length: int) -> int | None:
        node = self.leaves + length
        if self.open[node]:
            return length
        while node > 1:  # up until a right neighbour holds an open bin, then down its left edge
            if not node & 1 and self.open[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.open[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return None

    def place(self, length: int) -> tuple[int, int]:
        """``(bin, offset)`` of the next piece."""
        room = self._tightest(length)
        if room is None:
            bin_id, room = self.made, self.capacity
            self.made += 1
        else:
            bin_id = self.bins[room].pop()
            self._count(room, -1)
        left = room - length
        if left:
            self.bins[left].append(bin_id)
            self._count(left, 1)
        return bin_id, self.capacity - room


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``: the pieces of every document, its end id included."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc, rows = tokens.encoder(tokenizer), []
        end = struct.pack("<I", END_ID)
        for doc_id, raw in zip(column(batch, "doc_id").to_pylist(), enc.encode_batch(texts(batch))):
            raw += end
            for k, lo in enumerate(range(0, len(raw), 4 * capacity)):
                part = raw[lo:lo + 4 * capacity]
                rows.append((doc_id, k, lo // 4, len(part) // 4, zlib.crc32(part)))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.int32(), *[pa.int64()] * 3])],
            names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_texts(docs, doc_columns(id_col, text_col),
                     "doc_id long, piece int, start long, length long, ids_crc32 long", run)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, group: int = GROUP, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``: every piece and its place.

    Null and empty texts hold only the end id and are packed too. Repeated rows are packed once
    each; null ids are kept; other columns are ignored; empty input gives no rows.
    """
    cut = save(pieces(docs, tokenizer, capacity, id_col, text_col), "pieces")
    rest = cut.where(F.col("length") < capacity).count()
    groups = max(1, -(-rest // group))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = [b for b in batches if b.num_rows]
        if not mine:
            return
        part = pa.Table.from_batches(mine).sort_by(
            [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        fit = BestFit(capacity)
        bins, offsets = zip(*map(fit.place, part["length"].to_pylist()))
        first = TaskContext.get().partitionId() << 32
        part = (part.append_column("sequence_id", pa.array(np.array(bins, dtype=np.int64) + first))
                .append_column("offset", pa.array(offsets, pa.int64())))
        yield from part.combine_chunks().to_batches(max_chunksize=10_000)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    packed = cut.where(F.col("length") < capacity).repartition(groups).mapInArrow(run, schema)
    full = cut.where(F.col("length") == capacity).select(  # odd numbers, so that they never meet a packed one
        "*", (F.monotonically_increasing_id() * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return full.union(packed.withColumn("sequence_id", F.col("sequence_id") * 2))
