"""Plan helpers of the subpackage: shared folder, partitions, components."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.plans.scale import checked_broadcast
from palaver.session import checkpoint_dir

BROADCAST_IDS = 500_000  # ids of 8 bytes: a few MB, checked before every use


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared folder that the session names."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table once into the shared folder and go on from it."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def only(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key is in ``ids``: by broadcast behind a count, else by shuffle."""
    return df.join(checked_broadcast(ids, BROADCAST_IDS), key, "left_semi")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable, of every node of ``edges`` (a, b).

    Alternating large-star and small-star rounds; each round only groups by a
    node with a minimum (combined map side) and joins it back, and is written
    to the shared folder.  The number of rounds grows with the logarithm of the
    number of nodes.
    """
    e = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        now = e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("label"))
        before = now
