"""Session helpers: a local session for tests/bench and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "latencylab") -> SparkSession:
    """Local session used by tests and bench (a cluster supplies its own session)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder.

    On a cluster the folder is the session's ``spark.checkpoint.dir`` (a shared file
    system), or a checkpoint dir already set on the SparkContext. Only when neither
    exists, as in local tests, a scratch folder is created and registered with
    ``setCheckpointDir`` (``spark.checkpoint.dir`` itself cannot change at runtime).
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    key = id(sc)
    if key not in _SCRATCH:
        existing = sc.getCheckpointDir()
        if existing:
            _SCRATCH[key] = existing
        else:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
            path = tempfile.mkdtemp(prefix="latencylab-ckpt-")
            sc.setCheckpointDir(path)
            _SCRATCH[key] = path
    return _SCRATCH[key]


_SCRATCH: dict = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A folder under the shared checkpoint dir for written intermediate tables."""
    return os.path.join(ensure_checkpoint_dir(spark), name)


# Settings for a large cluster (pass to the session builder or spark-submit).
# Partitions are sized by AQE from measured shuffle sizes; skewed join partitions
# are split; dimension tables are broadcast only below the measured threshold.
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
}
