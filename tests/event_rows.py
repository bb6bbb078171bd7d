"""Event rows for the tests; a module of its own name, so that no conftest.py can shadow it."""

DAY = 86_400_000

EVENT_SCHEMA = ("id long, event_name string, user_id long, slug string, status int, duration_ms long, "
                "source string, created_at long")


def make_events(spark, rows):
    """rows: (user_id, event_name, slug, status, duration_ms, created_at)."""
    data = [(i + 1, e, u, s, st, d, "shortcut-key", t) for i, (u, e, s, st, d, t) in enumerate(rows)]
    return spark.createDataFrame(data, EVENT_SCHEMA)
