"""Session construction and the settings every job relies on."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Settings the library's semantics depend on (not tuning knobs):
#  * UTC day boundaries for every epoch-ms <-> timestamp conversion,
#  * LAST_WIN map-key dedup so parsed choice lists keep the last duplicate, and the same for
#    repeated names in JSON objects.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.variant.allowDuplicateKeys": "true",
}

# Scale defaults: AQE re-plans joins and coalesces / splits partitions at runtime,
# the skew-join rule splits a hot user's partition instead of running it in one task.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Skip PySpark's per-call Python call-site capture (error context only); it costs a
    # JVM round trip per DataFrame/Column call while plans are being built.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # Streaming state off-heap in RocksDB (state larger than executor memory at scale).
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Remove reliable-checkpoint files once their DataFrame is garbage-collected.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # Cap on what the planner may broadcast on its own; explicit broadcasts in this
    # library are only applied to fixed-size dimension tables (prices, products, labels).
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``meterline`` importable in Python workers/executors (once per application).

    The ordered folds run Python inside tasks; their step functions are pickled by
    reference, so executors need the package -- the ``--py-files`` mechanism.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    parent = os.path.dirname(pkg)
    path = os.path.join(tempfile.mkdtemp(prefix="meterline-pkg-"), "meterline.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith((".py", ".json")):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, parent))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def apply_conf(spark: SparkSession) -> SparkSession:
    """Pin the semantic settings on an existing session (idempotent)."""
    for k, v in REQUIRED_CONF.items():
        spark.conf.set(k, v)
    given = spark.sparkContext.getConf()
    for k, v in SCALE_CONF.items():
        if not given.contains(k) and spark.conf.isModifiable(k):  # what the cluster sets itself stays
            spark.conf.set(k, v)
    ship_package(spark)
    return spark


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "meterline") -> SparkSession:
    """Local/test session builder. On a cluster, pass the cluster's session to ``apply_conf``."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    b = b.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    b = b.config("spark.driver.memory", os.environ.get("METERLINE_DRIVER_MEMORY", "16g"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in {**REQUIRED_CONF, **SCALE_CONF}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return apply_conf(spark)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session that names none (tests) gets a scratch folder of its own; on a
    cluster a folder of one machine would be invisible to the others, so that is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="meterline-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def materialize(df):
    """Cut lineage: reliable checkpoint into the session's shared checkpoint folder.

    Used where one intermediate feeds several self-joins/aggregates, so the plan reads
    the written result instead of re-expanding (and re-scanning) its whole lineage at
    every reference.  Reliable (not local) checkpoints survive executor loss.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
