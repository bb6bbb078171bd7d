"""Hard-negative mining (operator 13): slot-decomposed selection of the best rows below each positive.

An anchor's positives are its best rows of the same label. Every positive asks for the best rows of
other labels whose score lies in a window below the positive's own score. These windows overlap; their upper limits
cut the scores of an anchor into disjoint slots (above the largest limit, between two limits, below
the least). Each row falls into one slot, and a slot needs its best ``k`` rows only. The window of a positive lies in its slot and those
below it, so the best ``k`` of all windows of an anchor follow from the few kept rows, in one descending merge of slots.

The anchors are a stated query set against all rows: they go out in groups of at most ``GROUP_BYTES`` of vectors, one pass over
the rows each, so memory and broadcast do not grow with the table. In a pass every task scores its rows against the group, one block after
another, and keeps the best ``k`` of every anchor and slot (the combiner); only these are shuffled, and neither a label
nor a copy that holds a third of the rows makes a large group.

Rows with a null label, a null vector, a null or non-finite component, or a null id take no part. Vectors of
different lengths are compared as if the shorter one ended in zeros; an empty vector scores 0 with all. Rows that
share the anchor's id are the anchor itself, never its positives or negatives; a row that repeats
counts each time, and equal rows of an anchor are one anchor. Scores are exact integers; one beyond a long counts as the nearest
long. Ties go to the smaller id. Labels of any type are compared as texts. Further columns are not read. Empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.llm.common import save

SCALE = 256
BATCH = 1024  # rows scored at once
ANCHORS = 512  # anchors scored at once; their scores with a batch take 4 MB
GROUP_BYTES = 8 << 20  # vectors of the anchors of one pass, as longs
_LOW = np.iinfo(np.int64).min


def vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label: str | Column = "label",
            scale: int = SCALE) -> DataFrame:
    """``(vec_id, label, v)``: the rows that take part, each component ``x`` as the integer ``floor(scale * x)``."""
    v = F.transform(F.col(vector_col), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    label = F.col(label) if isinstance(label, str) else label
    whole = F.forall(F.col(vector_col), lambda x: F.coalesce(
        ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))), F.lit(False)))
    return (table.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & whole)
            .select(F.col(id_col).cast("long").alias("vec_id"), label.cast("string").alias("label"), v.alias("v"))
            .where("label is not null"))


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of ``a`` with those of ``b``, held within a long."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if not width:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    most = float(np.abs(a.astype(float)).max()) * float(np.abs(b.astype(float)).max()) * width
    if most < 2 ** 53:  # then every partial sum is a whole number that a double holds
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    if most < 2 ** 62:
        return a @ b.T
    exact = a.astype(object) @ b.T.astype(object)
    return np.clip(exact, _LOW + 1, np.iinfo(np.int64).max).astype(np.int64)


class Best:
    """The best ``k`` scores, and their ids, of each anchor and slot."""

    def __init__(self, anchors: int, slots: int, k: int):
        self.k = k
        self.score = np.full((slots, anchors, k), _LOW, dtype=np.int64)
        self.id = np.zeros((slots, anchors, k), dtype=np.int64)

    def add(self, slot: int, first: int, s: np.ndarray, ids: np.ndarray, fits: np.ndarray) -> None:
        """Take in those of ``s`` (anchors from ``first`` on x rows) that fit."""
        floor = self.score[slot, first:first + len(s), -1:]
        fits = fits & (s >= floor)
        for row in np.flatnonzero(fits.any(axis=1)):
            at, here = np.flatnonzero(fits[row]), (slot, first + row)
            if len(at) > 4 * self.k:  # the k best with all their ties
                some = s[row, at]
                at = at[some >= np.partition(some, len(some) - self.k)[-self.k]]
            all_s = np.concatenate([self.score[here], s[row, at]])
            all_i = np.concatenate([self.id[here], ids[at]])
            order = np.lexsort((all_i, ~all_s))[:self.k]
            self.score[here], self.id[here] = all_s[order], all_i[order]


def _matrix(lists: pa.ListArray) -> np.ndarray:
    """Lists of whole numbers as rows; shorter ones end in zeros."""
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    m = np.zeros((len(lists), int(lengths.max(initial=0))), dtype=np.int64)
    m[np.arange(m.shape[1])[None, :] < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return m


def _candidates(rows: DataFrame, anchors: pa.Table, k: int, same: bool) -> DataFrame:
    """``(anchor, slot, score, vec_id)``: the best ``k`` rows of each task for every anchor and slot.

    ``same``: rows of the anchor's label, in one slot. Otherwise rows of other labels: slot ``j`` holds scores of at most the ``j``-th
    limit and above the next one; what is above the first limit is in no window.
    """
    anchors = anchors.combine_chunks()
    lists = {c: anchors.column(c).combine_chunks() for c in anchors.column_names}
    limits = None
    if not same:
        per = _matrix(lists["limits"])
        n = lists["limits"].value_lengths().to_numpy(zero_copy_only=False)
        limits = np.where(np.arange(per.shape[1] + 1)[None, :] < n[:, None], np.pad(per, ((0, 0), (0, 1))), _LOW)
    sent = rows.sparkSession.sparkContext.broadcast((
        lists["anchor"].to_numpy(), lists["vec_id"].to_numpy(), np.array(lists["label"].to_pylist()), _matrix(lists["v"]), limits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, a_ids, a_labels, a_vectors, limits = sent.value
        best = Best(len(keys), 1 if same else limits.shape[1] - 1, k)
        for batch in batches:
            ids, labels, vs = batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist()), _matrix(batch.column(2))
            for at in range(0, len(keys) if len(ids) else 0, ANCHORS):
                part = slice(at, at + ANCHORS)
                s = scores(a_vectors[part], vs)
                alike = a_labels[part, None] == labels[None, :]
                fits = (alike if same else ~alike) & (a_ids[part, None] != ids[None, :])
                if same:
                    best.add(0, at, s, ids, fits)
                    continue
                for j in range(limits.shape[1] - 1):
                    best.add(j, at, s, ids, fits & (s <= limits[part, j:j + 1]) & (s > limits[part, j + 1:j + 2]))
        slot, row, at = np.nonzero(best.score > _LOW)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys[row]), pa.array(slot.astype(np.int32)), pa.array(best.score[slot, row, at]), pa.array(best.id[slot, row, at])],
            names=["anchor", "slot", "score", "vec_id"])

    found = save(rows.select("vec_id", "label", "v").mapInArrow(run, "anchor long, slot int, score long, vec_id long"), "negative-best")
    sent.destroy()
    return found


def _best(rows: DataFrame, anchors: DataFrame, groups: int, k: int, same: bool) -> DataFrame:
    """``(anchor, best)``: the ``k`` best of every slot of an anchor, over all tasks and slots, best first."""
    passes = [_candidates(rows, anchors.where(F.col("part") == g).drop("part").toArrow(), k, same) for g in range(groups)]
    ranked = reduce(DataFrame.union, passes).withColumn("rank", F.expr(
        "row_number() over (partition by anchor, slot order by score desc, vec_id)")).where(F.col("rank") <= k)
    return ranked.groupBy("anchor").agg(F.sort_array(F.collect_list(
        F.struct((-F.col("score")).alias("neg"), "vec_id"))).alias("best"))


def mine(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, least: int = 80) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``rows`` are those of ``vectors``; ``anchors`` is a condition on them. For every anchor and each of its ``positives`` best rows of the
    same label: the ``negatives`` best rows of other labels with a score from ``least`` percent of the positive's score up to that score.
    """
    spark = rows.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    rows = save(rows, "negative-rows")
    chosen = save(rows.where(anchors).withColumn("anchor", F.xxhash64("vec_id", "label", "v")).dropDuplicates(["anchor"]), "anchors")
    held = chosen.agg(F.coalesce(F.sum(F.size("v") + 8), F.lit(0))).first()[0]
    groups = -(-held * 8 // GROUP_BYTES) or 1
    chosen = chosen.withColumn("part", F.pmod("anchor", F.lit(groups)))
    own = save(_best(rows, chosen, groups, positives, True), "positives")
    limits = F.array_distinct(F.transform("best", lambda x: -x["neg"]))
    limited = save(chosen.join(own.select("anchor", limits.alias("limits")), "anchor"), "anchors-limits")
    found = _best(rows, limited, groups, negatives, False)
    # descending merge: what a positive may take begins in its own slot and goes on in those below
    score = -F.col("p.neg")
    wide = "decimal(22,0)"
    window = F.slice(F.filter("best", lambda x: (-x["neg"] <= score) & (
        (-x["neg"]).cast(wide) * 100 >= score.cast(wide) * least)), 1, negatives)
    return (own.select("anchor", F.explode("best").alias("p")).join(found, "anchor")
            .select("anchor", "p", F.posexplode(window).alias("at", "x"))
            .join(chosen.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
            .select("anchor_id", F.col("p.vec_id").alias("positive_id"), (F.col("at") + 1).alias("rank"),
                    F.col("x.vec_id").alias("negative_id"), score.alias("positive_score"), (-F.col("x.neg")).alias("negative_score")))


ORACLE_SQL = """
WITH ok AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
met AS (SELECT a.vec_id AS anchor_id, r.vec_id AS id, r.label = a.label AS same,
    CAST(list_sum(list_transform(list_zip(a.v, r.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM ok a JOIN ok r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
pos AS (SELECT anchor_id, id, score FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS n
  FROM met WHERE same) WHERE n <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM (
  SELECT p.anchor_id, p.id AS positive_id, m.id AS negative_id, p.score AS positive_score, m.score AS negative_score,
    CAST(ROW_NUMBER() OVER (PARTITION BY p.anchor_id, p.id ORDER BY m.score DESC, m.id) AS INTEGER) AS rank
  FROM pos p JOIN met m ON m.anchor_id = p.anchor_id AND NOT m.same
    AND 80 * p.score <= 100 * m.score AND 100 * m.score <= 100 * p.score) WHERE rank <= 5
"""
