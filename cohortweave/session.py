"""Session helpers: the settings the library relies on, and the checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

# Runtime settings.  A forced skew split lets AQE cut a hot join key even when
# the join's output partitioning is used again by a later aggregate.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Set the runtime options of ``RUNTIME_CONF`` on a running session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def build_local(cores: str | int = "*", memory: str = "8g", partitions: int = 8,
                name: str = "cohortweave") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Checkpoint folder: the cluster's ``spark.checkpoint.dir``, else a local test folder.

    Only a session without that setting (a test session) gets a temporary
    folder, because a machine-local folder does not survive a lost executor.
    """
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    target = shared or tempfile.mkdtemp(prefix="cohortweave-ckpt-")
    sc.setCheckpointDir(target)
    return target


def staged(df: DataFrame) -> DataFrame:
    """The frame, computed once and kept in the checkpoint folder.

    For frames that several later passes read: it survives lost executors and cuts
    the lineage of iterative fits.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
