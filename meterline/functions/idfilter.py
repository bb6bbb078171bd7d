"""A Bloom filter of ids that splits a table before an exact join.

The filter is an array of longs in one broadcast row: ``bit_or`` of the bits of all ids, added up map-side. It has ``BITS_A_ID`` bits an id, up to
``MOST_BITS`` (1 MB), so its size has a bound; with more ids it lets more rows through to the exact join, and the result is the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_A_ID = 16
LEAST_BITS, MOST_BITS = 1 << 10, 1 << 23
PROBES = 4
FEW = 500_000  # ids that go out as they are (4 MB); more of them are filtered first


class IdFilter:
    def __init__(self, ids: DataFrame, col: str):
        """``ids``: distinct, not null. Counting them takes one job."""
        n = ids.count()
        self.ids, self.few = ids.select(F.col(col).cast("long").alias("_id")), n <= FEW
        self.bits = min(max(LEAST_BITS, 1 << max(0, n * BITS_A_ID - 1).bit_length()), MOST_BITS)
        places = ids.select(F.explode(F.array(*self._places(F.col(col)))).alias("at"))
        longs = places.groupBy(F.shiftright("at", 6).cast("int").alias("slot")).agg(
            F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(63).cast("int"))).alias("word"))
        word = F.map_from_entries(F.collect_list(F.struct("slot", "word")))
        row = longs.agg(word.alias("m"))  # at most MOST_BITS / 64 entries
        self.row = row.select(F.transform(F.sequence(F.lit(0), F.lit(self.bits // 64 - 1)),
                                          lambda i: F.coalesce(F.element_at("m", i), F.lit(0).cast("long"))).alias("_words"))

    def _places(self, key: Column) -> list[Column]:
        """``PROBES`` bit numbers of an id, from the two halves of one hash."""
        h = F.xxhash64(key.cast("long"))
        low, high = h.bitwiseAND(0xFFFFFFFF), F.shiftright(h, 32).bitwiseAND(0xFFFFFFFF)
        return [(low + high * i).bitwiseAND(self.bits - 1) for i in range(PROBES)]

    def _knows(self, key: Column) -> Column:
        out = F.lit(True)
        for at in self._places(key):
            word = F.get("_words", F.shiftright(at, 6).cast("int"))
            out = out & (F.call_function("shiftright", word, at.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1)
        return out

    def without(self, df: DataFrame, key: str) -> DataFrame:
        """``df`` without the rows that name one of the ids."""
        if self.few:
            return df.join(F.broadcast(self.ids), F.col(key) == F.col("_id"), "left_anti")
        out, doubtful = self.split(df, key)
        return out.unionByName(doubtful.join(self.ids, F.col(key) == F.col("_id"), "left_anti"))

    def cleared(self, df: DataFrame, key: str) -> DataFrame:
        """``df`` with the id set to null in the rows that name one of the ids."""
        def mark(rows: DataFrame, ids: DataFrame) -> DataFrame:
            return rows.join(ids, F.col(key) == F.col("_id"), "left").select(
                *[F.when(F.col("_id").isNull(), F.col(c)).alias(c) if c == key else F.col(c) for c in df.columns])

        if self.few:
            return mark(df, F.broadcast(self.ids))
        out, doubtful = self.split(df, key)
        return out.unionByName(mark(doubtful, self.ids))

    def split(self, df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
        """``(out, doubtful)``: rows whose id is null or surely none of the ids, and all others."""
        joined = df.crossJoin(F.broadcast(self.row))  # one row
        known = F.coalesce(self._knows(F.col(key)) & F.col(key).isNotNull(), F.lit(False))
        return joined.where(~known).select(*df.columns), joined.where(known).select(*df.columns)
