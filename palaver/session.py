"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import os

import palaver
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),  # Spark's default; queries over the tables take less
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings every operator relies on.

    Task functions travel by value, so workers need not have the package.
    """
    cloudpickle.register_pickle_by_value(palaver)
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cpus: int = 8, memory: str = "12g", **extra: str) -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("palaver")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
    )
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``, else one in the warehouse.

    The warehouse, too, is a folder that driver and executors share; a
    machine-local folder would be lost with its executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_runs")
        spark.conf.set("spark.checkpoint.dir", folder)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a table into the shared folder and go on from it.

    Like a reliable checkpoint it survives the loss of executors; as a table it
    also has true statistics and is read by column.
    """
    spark = df.sparkSession
    path = scratch_table(spark, "step")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_table(spark: SparkSession, name: str) -> str:
    """Path of a fresh table folder below the shared folder.

    All tables of an application lie in one folder named after it, which can go
    when the application has ended.
    """
    import uuid

    return os.path.join(checkpoint_dir(spark), spark.sparkContext.applicationId, f"{name}-{uuid.uuid4().hex}")
