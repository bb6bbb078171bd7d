"""S2 catalog scan: the nested automation catalog (explicit schema) to one row per automation.

The catalog is a fixed-size dimension (a few dozen automations); joining it with an
explicit broadcast is safe at any data scale.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CATALOG_PATH = os.path.join(os.path.dirname(__file__), "data", "catalog.json")
S, B, L = T.StringType(), T.BooleanType(), T.LongType()

AUTOMATION = T.StructType([
    T.StructField("slug", S), T.StructField("name", S), T.StructField("tagline", S),
    T.StructField("category", S), T.StructField("icon", S), T.StructField("color", S),
    T.StructField("trigger", S), T.StructField("runTip", S),
    T.StructField("inside", T.ArrayType(T.StructType([T.StructField("action", S), T.StructField("detail", S)]))),
    T.StructField("typicalCost", T.DoubleType()), T.StructField("icloudUrl", S), T.StructField("block", B),
    T.StructField("tags", T.ArrayType(S)), T.StructField("input", S), T.StructField("output", S),
    T.StructField("pairWith", T.ArrayType(S)),
    # private fields (never exported)
    T.StructField("model", S), T.StructField("typicalTokens", T.ArrayType(L)), T.StructField("prompt", S),
    T.StructField("system", S), T.StructField("choices", T.ArrayType(S)), T.StructField("image", B),
    T.StructField("acceptsImage", B), T.StructField("imageModel", S),
    T.StructField("defaultInstructions", S), T.StructField("needsInstructions", S),
    T.StructField("format", S), T.StructField("picksChoice", B), T.StructField("audio", B),
    T.StructField("typicalMinutes", T.DoubleType()), T.StructField("recipeVersion", L), T.StructField("makesImage", B),
])
CATALOG_SCHEMA = T.StructType([T.StructField("categories", T.ArrayType(S)),
                               T.StructField("automations", T.ArrayType(AUTOMATION))])

# the public projection (16 fields); prompts and models stay private.
PUBLIC_FIELDS = ["slug", "name", "tagline", "category", "icon", "color", "trigger", "runTip", "inside",
                 "typicalCost", "icloudUrl", "block", "tags", "input", "output", "pairWith"]


def read_catalog(spark: SparkSession, path: str | None = None) -> DataFrame:
    """One row per automation, with its position (catalog order) as ``pos``.

    A catalog on shared storage is scanned with ``spark.read.json`` (explicit schema,
    multi-line); the bundled catalog ships inside the package, so it is parsed on the
    driver and handed to Spark as one row (executors never see driver-local paths).
    """
    if path is None:
        raw = spark.createDataFrame([_as_row(catalog_dict())], CATALOG_SCHEMA)
    else:
        raw = spark.read.schema(CATALOG_SCHEMA).option("multiLine", "true").json(path)
    return raw.select(F.posexplode("automations").alias("pos", "a")).select("pos", "a.*")


def _as_row(doc: dict) -> tuple:
    """Nested dict -> tuple structure matching CATALOG_SCHEMA (absent fields -> None)."""
    def conv(v, t):
        if v is None:
            return None
        if isinstance(t, T.StructType):
            return tuple(conv(v.get(f.name), f.dataType) for f in t.fields)
        if isinstance(t, T.ArrayType):
            return [conv(x, t.elementType) for x in v]
        if isinstance(t, T.DoubleType):
            return float(v)
        return v
    return conv(doc, CATALOG_SCHEMA)


def catalog_dict(path: str = CATALOG_PATH) -> dict:
    with open(path) as f:
        return json.load(f)
