"""Materialisation of an intermediate result that several branches read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``; where it is unset, one in the warehouse, which is shared too."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints")
    return sc.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """Run ``df`` once and keep it in reliable storage.

    The result survives the loss of executors and keeps the partitioning of
    ``df``, so later steps on the same keys need no new shuffle.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
