"""KPI layer: rates, period change, labels (V1-V11, X14-X17, J16) over aggregate outputs.

All inputs here are the small outputs of the aggregate jobs (one row per period,
cohort week, status, source, slug or day), so 1-row cross joins and explicit broadcasts
of the label tables are bounded by construction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Display labels for statuses, sources and API-only slugs.
STATUS_LABELS = {400: "Input rejected", 402: "Insufficient credit", 404: "Unknown shortcut",
                 413: "Input too large", 422: "Unusable output", 429: "Rate limited", 500: "Server error",
                 502: "Provider error", 503: "Service unavailable"}
SOURCE_LABELS = {"iphone-app": "iPhone app key", "shortcut-key": "Shortcut key", "api": "Custom API key",
                 "unknown": "Unknown source"}
SLUG_LABELS = {"custom-api": "Custom API", "raw-api": "Raw model API", "retired-shortcut": "Unknown shortcut"}
DASH = "—"
MINUS = "−"


def ratio(n: Column, d: Column) -> Column:
    """V1: n / d, NULL when the denominator is 0 or NULL."""
    return F.when(F.coalesce(d, F.lit(0)) != 0, n / d)


def num_text(x: Column) -> Column:
    """en-US number with grouping and at most one decimal (trailing .0 dropped)."""
    r = F.round(x.cast("double"), 1)
    return F.when(r.isNull(), F.lit(None)).when(r == F.floor(r), F.format_number(r, 0)) \
        .otherwise(F.format_number(r, 1))


def percent_text(n: Column, d: Column) -> Column:
    return F.when(F.coalesce(d, F.lit(0)) != 0, F.concat(num_text(F.lit(100) * n / d), F.lit("%"))) \
        .otherwise(F.lit(DASH))


def change_text(n: Column, prev: Column, covered: Column | bool = True) -> Column:
    """V2: period change with the wording for uncovered / zero baselines."""
    cov = F.lit(covered) if isinstance(covered, bool) else covered
    pct = num_text(F.abs(n - prev) / prev * 100)
    return (F.when(~cov, F.lit("Comparison collecting history"))
            .when(F.coalesce(prev, F.lit(0)) == 0,
                  F.when(F.coalesce(n, F.lit(0)) != 0, F.lit("No prior-period baseline"))
                  .otherwise(F.lit("No change from prior period")))
            .otherwise(F.concat(F.when(n >= prev, F.lit("+")).otherwise(F.lit(MINUS)), pct,
                                F.lit("% vs prior period"))))


def duration_text(ms: Column) -> Column:
    """Ms / s / min / hr at 1e3, 6e4, 3.6e6; NULL -> em dash."""
    return (F.when(ms.isNull(), F.lit(DASH))
            .when(ms < 1000, F.concat(num_text(ms), F.lit(" ms")))
            .when(ms < 60000, F.concat(num_text(ms / 1000), F.lit(" s")))
            .when(ms < 3600000, F.concat(num_text(ms / 60000), F.lit(" min")))
            .otherwise(F.concat(num_text(ms / 3600000), F.lit(" hr"))))


def usd_text(micros: Column, digits: int = 2) -> Column:
    """``$x.xx`` (four digits for sub-cent reservations)."""
    return F.concat(F.lit("$"), F.format_string(f"%.{digits}f", micros / F.lit(1e6)))


def day_label(ms: Column) -> Column:
    """X14: "Mon D, YYYY" (UTC)."""
    return F.date_format(F.timestamp_millis(ms), "MMM d, yyyy")


def label_table(spark, mapping: dict, key_type: str, name: str) -> DataFrame:
    return spark.createDataFrame([(k, v) for k, v in mapping.items()], f"key {key_type}, {name} string")


def with_status_label(df: DataFrame) -> DataFrame:
    """Status label; unlisted and missing codes are other failures."""
    lab = label_table(df.sparkSession, STATUS_LABELS, "int", "label")
    j = df.join(F.broadcast(lab), df["status"] == lab["key"], "left").drop("key")
    return j.withColumn("label", F.coalesce(F.col("label"), F.lit("Other failure")))


def with_source_label(df: DataFrame) -> DataFrame:
    lab = label_table(df.sparkSession, SOURCE_LABELS, "string", "label")
    j = df.join(F.broadcast(lab), df["source"] == lab["key"], "left").drop("key")
    return j.withColumn("label", F.coalesce(F.col("label"), F.col("source")))


def with_feature_name(df: DataFrame, catalog: DataFrame) -> DataFrame:
    """Catalog name/category, else the API label map, else the slug, else 'Unknown'."""
    spark = df.sparkSession
    cat = catalog.select(F.col("slug").alias("_cs"), F.col("name").alias("_cn"), F.col("category").alias("_cc"))
    lab = label_table(spark, SLUG_LABELS, "string", "_ln")
    j = (df.join(F.broadcast(cat), df["slug"] == cat["_cs"], "left")
         .join(F.broadcast(lab), df["slug"] == lab["key"], "left"))
    return (j.withColumn("name", F.coalesce("_cn", "_ln", "slug", F.lit("Unknown")))
            .withColumn("category", F.coalesce("_cc", F.lit("API")))
            .drop("_cs", "_cn", "_cc", "key", "_ln"))
