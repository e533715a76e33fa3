"""The corpus pipeline: documents in, token files out.

Language ID, near-duplicate removal, benchmark decontamination, mixing to
target weights and token files, in this order.  Every stage works on all that
its predecessor kept; ``run`` writes each result as Parquet into the shared
folder and reads it back for the next stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.llm import decontaminate, entries, language, mixing, near_dup, tokens
from palaver.llm.shared import BROADCAST_IDS, only, stored
from palaver.plans.scale import checked_broadcast
from palaver.session import configure

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

TEXT_BYTES = 2 << 20  # of rows handed to a Python task at a time; the tasks' own arrays are several times as large


def ready(spark: SparkSession) -> None:
    """The settings of all operators, and small batches: every stage hands whole texts to Python."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(TEXT_BYTES))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that some language explains; the others are rejected.

    Null texts and texts without a letter go; without labelled rows nothing is
    learned and all go; rows keep all their columns, repeated ones stay each.
    """
    ready(spark)
    return language.keep_known(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8 or more).

    A row is named by its doc_id; by a hash of doc_id and text where rows share
    the id or have none, so two texts under one id are two documents.  The least
    name of a group stays.  Rows equal in doc_id and text are one: the least by
    its other columns.  Should two names agree by accident, both texts stay.
    """
    ready(spark)
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    shared = stored(docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id"), "shared")
    named = docs.withColumn("_name", F.coalesce(doc_id, F.xxhash64(doc_id, text)))
    if shared.limit(1).count():
        marked = docs.join(checked_broadcast(shared.withColumn("_shared", F.lit(True)), BROADCAST_IDS), "doc_id", "left")
        named = marked.select(*docs.columns, F.when(F.col("_shared"), F.xxhash64(doc_id, text)).otherwise(F.coalesce(doc_id, F.xxhash64(doc_id, text))).alias("_name"))
    judged = near_dup.near_duplicates(named.select(F.col("_name").alias("doc_id"), "text")).where("kept")
    kept = stored(judged.groupBy("doc_id").agg(F.count("*").alias("rows")).withColumnRenamed("doc_id", "_name"), "kept")
    single = only(named, kept.where("rows = 1").select("_name"), "_name").select(docs.columns)
    several = only(named, kept.where("rows > 1").select("_name"), "_name")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    one = several.groupBy("doc_id", "text").agg(F.min(F.struct(*others)).alias("_rest")).select("doc_id", "text", "_rest.*")
    return single.unionByName(one.select(docs.columns))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with the benchmark.

    Null and empty texts and rows without a doc_id share none; rows that share
    a doc_id are judged each by its own text; an empty benchmark keeps all.
    """
    ready(spark)
    return decontaminate.drop_leaked(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    Documents without words are taken 0 times; null is a source of its own, the last.
    """
    ready(spark)
    return mixing.mixed_documents(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the token files written and read back."""
    ready(spark)
    return tokens.tokenised(docs, entries.tokenizer_file(), dtype="<u2")


STAGES: list[tuple[str, Stage]] = [
    ("language_id", known_language),
    ("near_dedup", one_of_each_group),
    ("decontamination", without_benchmark),
    ("source_mixing", mixed),
    ("token_files", token_files),
]

# mixtures, sketches and tokenisation are not expressible in SQL; the stages are tested against brute force
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    ready(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
