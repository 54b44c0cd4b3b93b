"""Tables that a job writes on its way, in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the shared checkpoint folder that the cluster names; one of its own only where it is unset and all runs on this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "/tmp/checkpoints"
        spark.sparkContext.setCheckpointDir(path)
    return f"{path.rstrip('/')}/lectern-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """A result written and read again: what follows from it in several ways is computed once, and survives lost executors."""
    folder = shared_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
