"""Sets of days as bit maps: one long for every 64 days of a reporting window.

Distinct days per key are ``bit_or`` of single-day bits, a plain long that Spark keeps in its hash
aggregation buffers and combines map-side; their number is ``bit_count``. Maps of parts of the data (micro-batches, days) merge by ``bit_or`` too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from meterline.functions.clock import day_of

WORD = 64


def day_maps(prefix: str, first_day: int, days: int, only: Column | None = None, ms: str = "created_at") -> list[Column]:
    """Aggregates ``<prefix>0``, ``<prefix>1``, ...: the days of ``[first_day, first_day + days)`` on which a row (that fits ``only``) falls."""
    out = []
    for i in range(-(-days // WORD)):
        lo = first_day + i * WORD
        at = day_of(ms) - F.lit(lo)
        here = (at >= 0) & (at < min(WORD, days - i * WORD))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.cast("int"))
        out.append(F.bit_or(F.when(here if only is None else here & only, bit)).alias(f"{prefix}{i}"))
    return out


def day_count(prefix: str, days: int) -> Column:
    """Number of days in the maps ``<prefix>0``, ...; null maps are empty."""
    return reduce(lambda a, b: a + b, [F.coalesce(F.bit_count(f"{prefix}{i}"), F.lit(0)) for i in range(-(-days // WORD))])
