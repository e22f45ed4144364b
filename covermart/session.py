"""Settings of the running Spark session that jobs rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster or the application names it.

    That is `spark.checkpoint.dir`, or the folder given to `SparkContext.setCheckpointDir`.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("Set spark.checkpoint.dir to a folder all executors share.")
    return folder.rstrip("/")
