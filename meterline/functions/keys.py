"""Join-key helpers for skew.

Rows whose join key is NULL never match, but an outer/anti join still shuffles them --
all to the single partition that NULL hashes to.  ``spread_nulls`` replaces a NULL key by
one of ``buckets`` values that no real key can equal (negative numbers for ids, which are
>= 0; a NUL-prefixed label for string keys), so those rows spread over many partitions
and still match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def spread_nulls(key: Column, *salt: Column, buckets: int = 4096, string: bool = False) -> Column:
    bucket = F.abs(F.xxhash64(*salt)) % buckets
    filler = F.concat(F.lit("\x00null-"), bucket.cast("string")) if string else F.lit(-1) - bucket
    return F.when(key.isNull(), filler).otherwise(key)
