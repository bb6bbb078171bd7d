"""Catalog operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.operators import pricing as pr
from meterline.sources import dims as D
from meterline.sources.catalog import PUBLIC_FIELDS


def search_text(cols: list[str], tags: str | None = "tags") -> Column:
    """Non-null fields and tags joined, lower-cased."""
    parts = [F.col(c) for c in cols]
    if tags:
        parts.append(F.array_join(F.coalesce(F.col(tags), F.array()), " "))
    return F.lower(F.concat_ws(" ", *parts))


def matching(df: DataFrame, query: str, cols: list[str], tags: str | None = "tags",
             category: str | None = None, blocks_only: bool = False) -> DataFrame:
    """X3 + F20: rows whose search text contains the query (or, with tags, whose tag
    equals it); optional category equality and block-only filters."""
    q = query.strip().lower()
    cond = F.lit(True) if not q else search_text(cols, tags).contains(q)
    if q and tags:
        cond = cond | F.exists(F.coalesce(F.col(tags), F.array()), lambda t: F.lower(t) == q)
    if category:
        cond = cond & (F.col("category") == category)
    if blocks_only:
        cond = cond & F.coalesce(F.col("block"), F.lit(False))
    return df.where(cond)


def public_catalog(catalog: DataFrame) -> DataFrame:
    """F23 + S8: public fields only (absent optional fields stay NULL -> omitted keys)."""
    return catalog.orderBy("pos").select(*PUBLIC_FIELDS)


def export_json(df: DataFrame) -> DataFrame:
    """One JSON document per row; NULL fields are omitted, as absent keys."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "true"}).alias("json"))


def related(catalog: DataFrame, slug: str) -> DataFrame:
    """``pairWith`` of one automation, in order, unknown slugs dropped."""
    pairs = (catalog.where(F.col("slug") == slug)
             .select(F.posexplode("pairWith").alias("rank", "slug")))
    return pairs.join(catalog.drop("pos"), "slug", "inner").orderBy("rank")


def visible_categories(catalog: DataFrame, categories: list[str], hidden: list[str] = ()) -> DataFrame:
    """Categories (in their order) with at least one visible automation."""
    spark = catalog.sparkSession
    cats = spark.createDataFrame([(i, c) for i, c in enumerate(categories)], "cpos int, category string")
    visible = catalog.where(~F.col("slug").isin(*hidden)) if hidden else catalog
    return cats.join(visible.select("category"), "category", "left_semi").orderBy("cpos")


def featured(catalog: DataFrame, slugs: list[str]) -> DataFrame:
    """An ordered pick list joined to the catalog, in the given order."""
    spark = catalog.sparkSession
    picks = spark.createDataFrame([(i, s) for i, s in enumerate(slugs)], "rank int, slug string")
    return picks.join(catalog.drop("pos"), "slug", "inner").orderBy("rank")


def merge_metadata(catalog: DataFrame, meta: DataFrame) -> DataFrame:
    """Attach discovery fields by slug, keeping catalog values where present."""
    m = meta.select("slug", *[F.col(c).alias(f"_m_{c}") for c in meta.columns if c != "slug"])
    j = catalog.join(m, "slug", "left")
    for c in meta.columns:
        if c == "slug":
            continue
        j = j.withColumn(c, F.coalesce(F.col(c), F.col(f"_m_{c}")) if c in catalog.columns else F.col(f"_m_{c}"))
        j = j.drop(f"_m_{c}")
    return j


def typical_cost(catalog: DataFrame, prices: DataFrame) -> DataFrame:
    """Typical cost (USD) per automation by type: image, classifier (500 tokens), or
    text tokens (+ audio minutes)."""
    p = prices.select("model", "price_in", "price_out")
    j = catalog.join(F.broadcast(p), "model", "left")
    tin, tout = F.element_at("typicalTokens", 1), F.element_at("typicalTokens", 2)
    text = pr.text_cost_expr(tin, tout, F.col("price_in"), F.col("price_out"))
    audio = F.when(F.coalesce(F.col("audio"), F.lit(False)),
                   pr.audio_cost_expr(F.col("typicalMinutes"))).otherwise(F.lit(0))
    micros = (F.when(F.coalesce(F.col("makesImage"), F.lit(False)), pr.image_cost_expr(tin, tout))
              .when(F.coalesce(F.col("picksChoice"), F.lit(False)), pr.classifier_cost_expr(F.lit(500)))
              .otherwise(text + audio))
    return j.select("slug", (micros / F.lit(float(D.MICROS))).alias("typicalCost"))


def cost_label(usd: Column) -> Column:
    """Cents to two significant digits, ``<0.01¢`` below a hundredth of a cent."""
    c = usd * 100
    e = F.floor(F.log10(c)) - 1
    r = F.round(c / F.pow(F.lit(10.0), e))
    # Divide by an exact power of ten (not multiply by 10^-k) so 12 -> 1.2, not 1.2000000000000002.
    two = F.when(e < 0, r / F.pow(F.lit(10.0), -e)).otherwise(r * F.pow(F.lit(10.0), e))
    text = F.regexp_replace(two.cast("string"), r"\.0$", "")
    return F.when(c < 0.01, F.lit("<0.01¢")).otherwise(F.concat(F.lit("~"), text, F.lit("¢")))


def result_count(df: DataFrame, by: str = "category") -> DataFrame:
    """Matches per group."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("matches"))


def categories_without_blocks(catalog: DataFrame, categories: list[str]) -> DataFrame:
    """J18 (anti): categories (in order) that contain no building block."""
    spark = catalog.sparkSession
    cats = spark.createDataFrame([(i, c) for i, c in enumerate(categories)], "cpos int, category string")
    blocks = catalog.where(F.coalesce(F.col("block"), F.lit(False))).select("category")
    return cats.join(blocks, "category", "left_anti").orderBy("cpos")
