"""Session settings the operators rely on, and the reliable checkpoint helper."""

from __future__ import annotations

import tempfile

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import lodestone

# Functions sent to Python workers travel by value, so the package need not be installed on them.
cloudpickle.register_pickle_by_value(lodestone)

# Runtime SQL settings; all of them can be changed on a live session.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators assume (UTC zone, AQE, skew-join splitting)."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names in ``spark.checkpoint.dir``.

    A temporary folder is set only on a local master, where driver and executors share a disk.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        context.setCheckpointDir(configured)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running iterative operators")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialize ``df`` in the checkpoint folder so that iterations neither recompute nor grow the plan."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
