"""Session settings the operators rely on."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

# Runtime settings only: nothing here needs a restart, and no value depends on the
# size of the machine. Skewed join keys are split by AQE from measured shuffle sizes,
# also where the split costs one more exchange.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for intermediate data.

    Where none is named, as in tests, one below the warehouse serves on a local master only: elsewhere
    executors may not see it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/intermediate"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialize a small iterative state so that each round plans from files."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def kept_once(df: DataFrame) -> DataFrame:
    """Mark what several branches of one plan read: computed once, when a job first needs it.

    Nothing runs while the plan is built. Parts lie on the executors, on disk where memory is short; a lost
    part is computed again. ``spark.catalog.clearCache()`` lets go of them.
    """
    return df.persist(StorageLevel.MEMORY_AND_DISK)
