"""Tables written once in the folder that driver and executors share, to cut lineage and compute a result once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode, where it is unset, a temporary folder; on a cluster that is an error."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))
        known = spark.sparkContext.getCheckpointDir()
    return known


def folder(spark: SparkSession, name: str) -> str:
    """A fresh folder's path in the shared one; deleted when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/lodestone-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def once(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back; deleted when the driver ends."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
