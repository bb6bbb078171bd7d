"""S1 table scan: read the driver tables with explicit schemas (never inferred).

``read_tables(spark, sf_dir)`` returns lazy DataFrames; Catalyst prunes columns and
pushes filters into each Parquet scan, so reading "all tables" costs nothing until a
query touches them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

L, I, S, D = T.LongType(), T.IntegerType(), T.StringType(), T.DoubleType()


def _st(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


SCHEMAS: dict[str, T.StructType] = {
    "region": _st(("r_regionkey", I), ("r_name", S)),
    "nation": _st(("n_nationkey", I), ("n_name", S), ("n_regionkey", I)),
    "customer": _st(("c_custkey", L), ("c_name", S), ("c_nationkey", I),
                    ("c_acctbal", D), ("c_mktsegment", S)),
    "supplier": _st(("s_suppkey", L), ("s_name", S), ("s_nationkey", I), ("s_acctbal", D)),
    "part": _st(("p_partkey", L), ("p_name", S), ("p_brand", S), ("p_type", S),
                ("p_size", I), ("p_retailprice", D)),
    "orders": _st(("o_orderkey", L), ("o_custkey", L), ("o_orderstatus", S),
                  ("o_totalprice", D), ("o_orderdate", T.TimestampNTZType()),
                  ("o_orderpriority", S)),
    "lineitem": _st(("l_orderkey", L), ("l_partkey", L), ("l_suppkey", L), ("l_linenumber", I),
                    ("l_quantity", D), ("l_extendedprice", D), ("l_discount", D), ("l_tax", D),
                    ("l_returnflag", S), ("l_linestatus", S),
                    ("l_shipdate", T.TimestampNTZType())),
    "events": _st(("event_id", L), ("ts", T.TimestampNTZType()), ("user_id", L),
                  ("event_type", S), ("value", D), ("props", S)),
    "documents": _st(("doc_id", L), ("text", S), ("lang", S), ("source", S), ("n_chars", L)),
    "embeddings": _st(("vec_id", L), ("embedding", T.ArrayType(T.FloatType())), ("label", I)),
    "pages": _st(("page_id", L), ("url", S), ("html", S)),
    "benchmark": _st(("item_id", L), ("text", S)),
    "labels": _st(("doc_id", L), ("quality", I), ("toxic", I)),
    "conversations": _st(("conv_id", L), ("turn", L), ("role", S), ("text", S)),
}

TABLES = tuple(SCHEMAS)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> dict[str, DataFrame]:
    return {n: read_table(spark, sf_dir, n) for n in names}
