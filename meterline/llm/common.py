"""Helpers shared by the training-data operators: table reading, written intermediates, Arrow maps."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.session import checkpoint_dir

# Rows per Arrow batch: whole texts travel in these, so a batch is kept to a few megabytes.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Shuffle files of an execution are removed at its end, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder of its own under the cluster's shared ``spark.checkpoint.dir``."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return path


def save(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder once and read the written table.

    The shuffle files of the write go when it ends: nothing else reads them. Every later use reads the same rows, whatever partitioning a re-run would choose, and
    a lost executor costs a re-read instead of a recomputation.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def discard(saved: DataFrame) -> None:
    """Delete the folder of a table that ``save`` wrote and nothing reads any more; without it the folder stays until the driver ends."""
    spark = saved.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(saved.saved_at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def map_texts(df: DataFrame, columns: list, schema: str,
              fn: Callable[[pa.RecordBatch], pa.RecordBatch | dict | None]) -> DataFrame:
    """``mapInArrow`` over the selected ``columns``; ``fn`` turns one batch into one batch (or a column dict)."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    out = df.select(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = fn(batch)
                if made is not None:
                    yield made

    return out.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Whole texts of a batch as str; null is the empty text."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def text_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """Whole texts of a batch as UTF-8 bytes; null is the empty text."""
    col = batch.column(batch.schema.get_field_index(name))
    return [t or b"" for t in col.cast(pa.binary() if col.type == pa.string() else pa.large_binary()).to_pylist()]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def doc_columns(id_col: str, text_col: str) -> list:
    return [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")]


# Numbers in a table that may be broadcast (8 MB); larger ones take part in ordinary joins.
SMALL = 1_000_000


def if_small(df: DataFrame, numbers=None) -> DataFrame:
    """``df`` marked for broadcast where it holds at most ``SMALL`` numbers (summed over rows), else as it is."""
    held = df.agg(F.coalesce(F.sum(F.lit(2) if numbers is None else numbers), F.lit(0))).first()[0]
    return F.broadcast(df) if held <= SMALL else df


def merged(side: DataFrame) -> DataFrame:
    """``side`` as the side of a join that is never broadcast: its rows grow with the input, and several broadcasts just under the threshold fill a driver."""
    return side.hint("merge")


def text_key(text_col: str = "text"):
    """Digest that tells the texts of rows with one id apart; null is the empty text."""
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(row, doc_id, h, text)``: every input row whole in ``row``, so its own column names clash with nothing."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.col(id_col).cast("long").alias("doc_id"), text_key(text_col).alias("h"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def without(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose ``(doc_id, h)`` is not in ``gone``, with all their columns."""
    side = if_small(gone.select(F.col("doc_id").alias("d"), F.col("h").alias("g")).distinct())
    left = keyed(docs, id_col, text_col).select("row", "doc_id", "h")
    kept = left.join(side, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")), "left_anti")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
