"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings the operators rely on.  Every one can also be given by the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A hot join key (one licence line in a third of the files, say) is split
    # into several tasks even if that costs one more exchange afterwards.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # The paths a stream has seen stay on disk, not on the executors' heaps.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def local_session(cpus: str | int = "*", name: str = "scriptorium", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    settings = {
        **SETTINGS,
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def working_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder under the cluster's shared ``spark.checkpoint.dir``.

    Only a local session without that setting falls back to a temporary folder:
    on a cluster a machine-local path would be lost with its executor.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="scriptorium-")
    return os.path.join(base, f"{label}-{uuid.uuid4().hex}")


def cut_lineage(rows: DataFrame) -> DataFrame:
    """Write ``rows`` to the shared checkpoint folder and read them from there; a lost executor costs no more than a read."""
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(working_dir(rows.sparkSession, "checkpoints"))
    return rows.checkpoint()


def stored(rows: DataFrame, label: str) -> DataFrame:
    """``rows`` as a table below the shared folder, for what costs much to make and is read more than once."""
    path = working_dir(rows.sparkSession, label)
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Hash ``rows`` over the cores if the scan has fewer splits than there are cores.

    Cutting text is bound by CPU, and a small table in one row group would keep all but
    one core idle.  A large table has more splits than cores and is left as it is, so
    this never shuffles one.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(2 * cores, key) if rows.rdd.getNumPartitions() < cores else rows
