"""Token-ID / binary output (operator 5): bit-plane shuffled id files.

A file holds the ids of a run of documents in ascending id order::

    magic | chunk 0 | chunk 1 | ... | index (zstd) | index length (8 bytes) | magic

Ids are cut into chunks of ``block`` ids. A chunk is transposed into planes (all first
bytes, all second bytes ...; or all first bits, all second bits ...), and each plane is a zstandard frame. The index
stores, per chunk, its offset, number of ids, crc32 and the length of each plane, and, per document, its id and
number of ids, so any document can be read by decoding only its chunks.

Ids are written as they are encoded: a task sorts one range of doc_ids and streams chunks to
its file under a name of its own, then renames it, so a repeated or lost attempt leaves
no half file under the final name.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterline.llm import tokens
from meterline.llm.common import column, doc_columns, map_texts, save, scratch, texts

MAGIC = b"PLANES01"
BLOCK = 65_536
LEVEL = 3
END_ID = 0


def to_planes(ids: np.ndarray, width: int, mode: str) -> list[bytes]:
    """Planes of an id block: ``width`` byte planes, or ``8 * width`` bit planes."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width]
    if mode == "byte":
        return [np.ascontiguousarray(raw[:, i]).tobytes() for i in range(width)]
    bits = np.unpackbits(np.ascontiguousarray(raw), axis=1, bitorder="little")
    return [np.packbits(bits[:, i], bitorder="little").tobytes() for i in range(8 * width)]


def from_planes(planes: list[bytes], n: int, width: int, mode: str) -> np.ndarray:
    raw = np.zeros((n, 4), dtype=np.uint8)
    if mode == "byte":
        for i, p in enumerate(planes):
            raw[:, i] = np.frombuffer(p, dtype=np.uint8)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, dtype=np.uint8), count=n, bitorder="little") for p in planes],
                        axis=1)
        raw[:, :width] = np.packbits(bits, axis=1, bitorder="little")
    return raw.view("<u4").reshape(-1)


class Writer:
    """Streams documents' ids into one file; ``close`` returns ``(documents, ids)``."""

    def __init__(self, out, width: int, mode: str = "byte", block: int = BLOCK, level: int = LEVEL):
        import zstandard
        self.out, self.width, self.mode, self.block = out, width, mode, block
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.at, self.held, self.n_held = len(MAGIC), [], 0
        self.chunks: list = []
        self.doc_ids: list = []
        self.lengths: list = []
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids))
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block:
            whole = np.concatenate(self.held)
            cut = len(whole) - len(whole) % self.block
            for lo in range(0, cut, self.block):
                self._chunk(whole[lo:lo + self.block])
            self.held, self.n_held = [whole[cut:].copy()], len(whole) - cut

    def _chunk(self, ids: np.ndarray) -> None:
        if int(ids.max(initial=0)) >= 1 << (8 * self.width):
            raise ValueError("an id does not fit the file's id width")
        planes = [self.zstd.compress(p) for p in to_planes(ids, self.width, self.mode)]
        self.chunks.append([self.at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), [len(p) for p in planes]])
        for p in planes:
            self.out.write(p)
            self.at += len(p)

    def close(self) -> tuple[int, int]:
        if self.n_held:
            self._chunk(np.concatenate(self.held))
        index = self.zstd.compress(json.dumps({
            "width": self.width, "mode": self.mode, "block": self.block, "chunks": self.chunks,
            "doc_ids": self.doc_ids, "lengths": self.lengths}).encode())
        self.out.write(index + struct.pack("<Q", len(index)) + MAGIC)
        return len(self.doc_ids), sum(self.lengths)


class Reader:
    """Reads a file by its index; ``ids(lo, hi)`` decodes only the chunks that hold that range."""

    def __init__(self, source, size: int):
        import zstandard
        self.source, self.zstd = source, zstandard.ZstdDecompressor()
        source.seek(size - 16)
        n, magic = struct.unpack("<Q8s", source.read(16))
        if magic != MAGIC:
            raise ValueError("not a bit-plane file")
        source.seek(size - 16 - n)
        self.index = json.loads(self.zstd.decompress(source.read(n)))

    def chunk(self, i: int) -> np.ndarray:
        at, n, crc, lengths = self.index["chunks"][i]
        self.source.seek(at)
        planes = [self.zstd.decompress(self.source.read(k)) for k in lengths]
        ids = from_planes(planes, n, self.index["width"], self.index["mode"])
        if zlib.crc32(ids.tobytes()) != crc:
            raise ValueError(f"chunk {i} is damaged")
        return ids

    def ids(self, lo: int, hi: int) -> np.ndarray:
        block = self.index["block"]
        parts = [self.chunk(i)[max(0, lo - i * block):hi - i * block] for i in range(lo // block, -(-hi // block))]
        return np.concatenate(parts) if parts else np.array([], dtype="<u4")

    def documents(self) -> Iterator[tuple]:
        """``(doc_id, n_ids, crc32 of its ids)`` in file order; a document longer than a chunk is read chunk by chunk."""
        held, at = np.array([], dtype="<u4"), 0
        for doc_id, n in zip(self.index["doc_ids"], self.index["lengths"]):
            left, crc = n, 0
            while left:
                if not len(held):
                    held, at = self.chunk(at), at + 1
                part, held = held[:left], held[left:]
                crc, left = zlib.crc32(part.tobytes(), crc), left - len(part)
            yield doc_id, n, crc


def _bounds(docs: DataFrame, id_col: str, n: int) -> list[float]:
    """``n - 1`` range bounds of the ids: a quantile sketch of one column, ``n`` numbers whatever the input."""
    ids = docs.select(F.col(id_col).cast("long").alias("i")).where("i IS NOT NULL")
    return ids.approxQuantile("i", [k / n for k in range(1, n)], 0.2 / n) if n > 1 else []


def write(docs: DataFrame, path: str, tokenizer: str, files: int | None = None, mode: str = "byte",
          block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, append ``END_ID``, write files in ascending id order under ``path``.

    Returns the written manifest ``(bucket, path, n_docs, n_ids)``, one row per file. Ids are cut into ranges by a
    quantile sketch; rows that share an id which spans several ranges are spread over those (any order
    among equal ids is ascending). Null ids come first, all in the first range; null texts are empty texts and hold only the end id.
    Repeated rows are written each. Very long texts are encoded whole and stored in blocks. Other columns are not read, whatever their names.
    Empty input writes no file.
    """
    spark = docs.sparkSession
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = _bounds(docs, id_col, n)

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = tokens.encoder(tokenizer)
        two = enc.vocabulary <= 1 << 16
        end = struct.pack("<I", END_ID)
        ids, buckets, rest = column(batch, "doc_id").to_pylist(), [], []
        found = [np.frombuffer(x + end, dtype="<u4") for x in enc.encode_batch(texts(batch))]
        for doc_id, x in zip(ids, found):
            crc = zlib.crc32(x)
            lo, hi = (0, 0) if doc_id is None else (bisect_left(bounds, doc_id), bisect_right(bounds, doc_id))
            buckets.append(lo + crc % (hi - lo + 1))
            rest.append(crc)
        return pa.RecordBatch.from_arrays(
            [pa.array(buckets, pa.int32()), column(batch, "doc_id"), pa.array(rest, pa.int64()),
             pa.array([(x.astype("<u2") if two else x).tobytes() for x in found], pa.binary())],
            names=["bucket", "doc_id", "crc", "ids"])

    encoded = map_texts(docs, doc_columns(id_col, text_col), "bucket int, doc_id long, crc long, ids binary", encode)
    dealt = encoded.repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", "doc_id", "crc")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = 2 if tokens.encoder(tokenizer).vocabulary <= 1 << 16 else 4
        store, root = pafs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        bucket = writer = out = temp = None

        def finish():
            n_docs, n_ids = writer.close()
            out.close()
            final = f"{root}/ids-{bucket:06d}.planes"
            store.move(temp, final)
            return pa.RecordBatch.from_pylist(
                [{"bucket": bucket, "path": f"{path}/ids-{bucket:06d}.planes", "n_docs": n_docs, "n_ids": n_ids}],
                schema=pa.schema([("bucket", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()),
                                  ("n_ids", pa.int64())]))

        for batch in batches:
            for b, doc_id, ids in zip(column(batch, "bucket").to_pylist(), column(batch, "doc_id").to_pylist(),
                                      column(batch, "ids")):
                if b != bucket:
                    if writer:
                        yield finish()
                    bucket, temp = b, f"{root}/ids-{b:06d}.{uuid.uuid4().hex}.writing"
                    out = store.open_output_stream(temp)
                    writer = Writer(out, width, mode, block)
                writer.add(doc_id, np.frombuffer(ids.as_buffer(), dtype=f"<u{width}"))
        if writer:
            yield finish()

    return save(dealt.mapInArrow(put, "bucket int, path string, n_docs long, n_ids long"), "planes-manifest")


def read(manifest: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` per document, decoded from the files of a manifest.

    ``start`` counts the ids of all documents in files and places before it: a running sum over one row per file.
    """
    order = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("bucket", "path", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(column(batch, "path").to_pylist(), column(batch, "first").to_pylist()):
                store, name = pafs.FileSystem.from_uri(path)
                with store.open_input_file(name) as source:
                    rows: list = []
                    for doc_id, n, crc in Reader(source, source.size()).documents():
                        rows.append((doc_id, start, n, crc))
                        start += n
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)],
                                                     names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = manifest.agg(F.count(F.lit(1))).first()[0]
    return (placed.repartition(max(1, files), "bucket")
            .mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def folder(spark) -> str:
    return scratch(spark, "planes")
