"""SimHash near-dedup (operator 6): pigeonhole blocks over 64-bit fingerprints.

Fingerprints of equal texts collapse first, so a group of copies of any size is one row.
Two fingerprints within ``radius`` bits differ in at most ``radius`` of ``radius + 2``
equal blocks, so they agree on some pair of blocks: each fingerprint is dealt out once per
pair of blocks, and only those that meet on a pair are compared. A block pair that
holds more than ``BUCKET`` different fingerprints is not compared all-against-all: its
members are dealt out again by every fingerprint within ``ceil(radius / 2)`` bits
of them. Close pairs still meet there (at a midpoint), and such a group cannot hold more
than 1 + 64 fingerprints for a radius of 1 or 2, so the work stays linear and no link is lost.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.llm.common import column, doc_columns, map_texts, merged, save, text_bytes, text_key, without
from meterline.llm.components import components

# Different fingerprints of one block pair that are still compared with each other directly.
BUCKET = 16


def fingerprint(data: bytes, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of the lower-cased (A-Z) words of a text; no words: zero."""
    words = data.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(g, seed) for g in grams], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), 8192):  # a very long text needs no more memory than its hashes
        part = hashes[start:start + 8192].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, h, fp)``: one row per document; ``fp`` is the fingerprint as a signed long, ``h`` a digest of the text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, shingle) for t in text_bytes(batch)], dtype=np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "h"), pa.array(fps)],
                                          names=["doc_id", "h", "fp"])

    return map_texts(docs, [*doc_columns(id_col, text_col), text_key(text_col).alias("h")],
                     "doc_id long, h long, fp long", run)


def block_masks(radius: int, keep: int) -> list[int]:
    """Bit masks of every choice of ``keep`` of the ``radius + keep`` blocks that the 64 bits are split into.

    Two fingerprints within ``radius`` bits differ in at most ``radius`` blocks, so they agree on one choice at least.
    """
    n = radius + keep
    edges = [64 * i // n for i in range(n + 1)]
    block = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:])]
    return [sum(block[i] for i in chosen) for chosen in combinations(range(n), keep)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _ball(bits: int) -> list[int]:
    return [signed(sum(1 << b for b in c)) for k in range(bits + 1) for c in combinations(range(64), k)]


def close_pairs(fps: DataFrame, radius: int = 2, bucket: int = BUCKET) -> DataFrame:
    """Links ``(a, b)`` that connect all fingerprints within ``radius`` bits, from distinct ``fp`` rows.

    Every returned link is within ``radius``; every two fingerprints within ``radius`` are
    linked directly or through a third one that is within ``radius`` of both.
    """
    if not 0 <= radius <= 4:
        raise ValueError("radius must be 0 to 4")
    if radius == 0:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).where(F.lit(False))
    # dealt out twice from one column, which is cheaper than to write and read all of it
    fps = save(fps.select("fp"), "fps")
    dealt = fps.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("p"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("k"))
        for i, m in enumerate(block_masks(radius, 2))])).alias("s")).select("s.p", "s.k", "fp")
    sizes = dealt.groupBy("p", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = save(dealt.join(merged(sizes), ["p", "k"]), "met")
    few = met.where(F.col("n") <= bucket)
    pairs = (few.select("p", "k", F.col("fp").alias("a"))
             .join(merged(few.select("p", "k", F.col("fp").alias("b"))), ["p", "k"]).where("a < b").select("a", "b"))
    reach = (radius + 1) // 2
    many = met.where(F.col("n") > bucket).select("fp").distinct()
    mids = (many.select("fp", F.explode(F.lit(_ball(reach))).alias("flip"))
            .select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid")).groupBy("mid").agg(F.collect_list("fp").alias("fps")).where("size(fps) > 1"))
    if radius == 2 * reach:  # all members of a midpoint are within the radius of each other: a star connects them
        far = mids.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b"))
    else:
        far = mids.select(F.explode("fps").alias("a"), "fps").select("a", F.explode("fps").alias("b"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    return pairs.union(far.where("a < b")).where(close).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``(doc_id, h, fp, root, component_id)``: one row per input row; ``root`` is the least fingerprint reachable.

    ``component_id`` is the least doc_id whose fingerprint is reachable over links of at most
    ``radius`` bits. Null and blank texts have fingerprint zero and link like any other;
    repeated rows each get their row; rows with a null id belong to their component but
    never name it (all ids null: null). Very long texts are fingerprinted whole, some thousand shingles at a time. A bit with
    as many ones as zeros is 0. Other columns are not read, whatever their names. Empty input gives an empty result.
    """
    marked = save(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    least = save(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = components(close_pairs(least.select("fp"), radius))
    named = least.join(merged(roots), least["fp"] == roots["node"], "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_fp = named.join(merged(ids), "root").select("fp", "root", "component_id")
    return marked.join(merged(by_fp), "fp").select("doc_id", "h", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component, all its columns kept: the row that has the component's id.

    Where rows repeat that id, the one with the least text digest stays; of rows equal in id and
    text, one. A component without any id keeps one row all the same.
    """
    found = save(near_duplicates(docs, shingle, radius, id_col, text_col), "near-duplicates")
    names = F.col("doc_id").eqNullSafe(F.col("component_id"))
    stays = found.where(names).groupBy("root").agg(F.min("h").alias("stays"))
    gone = found.join(merged(stays), "root").where(~(names & (F.col("h") == F.col("stays")))).select("doc_id", "h")
    kept = without(docs, save(gone, "near-gone"), id_col, text_col)
    if found.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        kept = kept.dropDuplicates([id_col, text_col])
    return kept
