"""Request telemetry: request log -> analytics events.

Only authenticated POSTs to the metered endpoints are recorded; payloads, prompts and
keys are never part of the output (the allow-listed columns are the whole schema).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Metered endpoint pattern and API-only slugs.
METERED_PATH = r"^/api/v1/(run/[^/]+|generate|ai/run/.+)\z"  # \z: end of input only
RUN_PREFIX = "/api/v1/run/"


def request_events(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """F9 + F10: ``requests`` (request_id, method, path, status, started_at, finished_at,
    user_id, can_mint) -> (id, event_name, user_id, slug, status, duration_ms, source, created_at)."""
    r = requests.where((F.col("method") == "POST") & F.col("path").rlike(METERED_PATH)
                       & F.col("user_id").isNotNull())
    shortcut = F.col("path").startswith(RUN_PREFIX)
    asked = F.when(shortcut, F.substring_index(F.col("path"), "/", -1))
    slugs = catalog.select(F.col("slug").alias("_known"))
    j = r.withColumn("_asked", asked).join(F.broadcast(slugs), F.col("_asked") == F.col("_known"), "left")
    slug = (F.when(shortcut, F.coalesce(F.col("_known"), F.lit("retired-shortcut")))
            .when(F.col("path").endswith("/generate"), F.lit("custom-api")).otherwise(F.lit("raw-api")))
    return j.select(F.col("request_id").alias("id"),
                    F.when(F.col("status") == 200, "run_succeeded").otherwise("run_failed").alias("event_name"),
                    "user_id", slug.alias("slug"), "status",
                    F.greatest(F.lit(0).cast("long"), F.col("finished_at") - F.col("started_at")).alias("duration_ms"),
                    F.when(F.col("can_mint"), "iphone-app").when(shortcut, "shortcut-key").otherwise("api")
                    .alias("source"),
                    F.col("finished_at").alias("created_at"))
