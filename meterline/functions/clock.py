"""F1 reporting clock and F4 day bucket.

The clock is computed on the driver from two integers (it is a parameter of the
report, not data), and enters plans as literals so Parquet min/max statistics and
partition pruning apply to ``created_at`` bounds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400_000
ALLOWED_DAYS = (7, 30, 90)
DEFAULT_DAYS = 30


@dataclass(frozen=True)
class Clock:
    now: int
    days: int
    end: int            # start of today UTC (exclusive upper bound of every period)
    start: int          # end - days
    previous_start: int  # start - days

    @property
    def end_day(self) -> int:
        return self.end // DAY

    @property
    def start_day(self) -> int:
        return self.start // DAY

    @property
    def previous_start_day(self) -> int:
        return self.previous_start // DAY


def clock(now_ms: int, days=DEFAULT_DAYS) -> Clock:
    """Half-open periods ``[start, end)``; invalid ``days`` falls back to 30."""
    try:
        d = float(days)
    except (TypeError, ValueError):
        d = float("nan")
    d = int(d) if d in ALLOWED_DAYS else DEFAULT_DAYS
    end = (int(now_ms) // DAY) * DAY
    start = end - d * DAY
    return Clock(now=int(now_ms), days=d, end=end, start=start, previous_start=start - d * DAY)


def day_of(ms: Column | str) -> Column:
    """UTC day number of an epoch-ms column (integer division)."""
    if isinstance(ms, str):
        return F.expr(f"{ms} div {DAY}")
    return F.floor(ms / F.lit(DAY)).cast("long")


def in_range(col: str, lo: int, hi: int) -> Column:
    """Half-open ``lo <= col < hi`` with literal bounds (pushes to the Parquet scan)."""
    return (F.col(col) >= F.lit(lo)) & (F.col(col) < F.lit(hi))
