"""meterline: product analytics, credit ledger and usage metering as Spark jobs.

Every operator is a pure function ``DataFrame(s), params -> DataFrame``.  The
reporting clock (``now_ms``) is always an explicit parameter; nothing reads the
wall clock.  Times are epoch milliseconds (LONG), money is integer micro-dollars.
"""

from meterline.session import build_session, checkpoint_dir  # noqa: F401

DAY = 86_400_000
