"""Writers: incremental, idempotent and guarded."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from palaver.operators.corpus import index_delta
from palaver.operators.history import number_turns
from palaver.plans.scale import scalar

C = F.col


def read_or_empty(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The table, or no rows when it does not exist yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def new_messages(incoming: DataFrame, stored: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows above the high-water mark: the largest stored id above 0, else 0."""
    mark = scalar(stored.where("id > 0"), F.coalesce(F.max("id"), F.lit(0)))
    fresh = incoming.where(C("id") > mark)
    return fresh if limit is None else fresh.orderBy("id").limit(limit)


def append_messages(incoming: DataFrame, path: str, limit: int | None = None) -> None:
    stored = read_or_empty(incoming.sparkSession, path, incoming.schema)
    new_messages(incoming, stored, limit).write.mode("append").parquet(path)


def write_index(chunks: DataFrame, path: str, *, rebuild: bool = False) -> None:
    """Store chunks with their vectors; only new ids unless rebuilding."""
    if rebuild:
        chunks.write.mode("overwrite").parquet(path)
        return
    stored = read_or_empty(chunks.sparkSession, path, "id string")
    index_delta(chunks, stored).write.mode("append").parquet(path)


def append_turns(batch: DataFrame, path: str) -> None:
    """Number new turns after the stored ones and append them; the flags
    default to false."""
    spark = batch.sparkSession
    stored = read_or_empty(spark, path, "chat_id bigint, user_id bigint, turn_idx int")
    flags = {c: F.coalesce(C(c), F.lit(False)) for c in ("refused", "rerank") if c in batch.columns}
    number_turns(batch.withColumns(flags), stored).write.mode("append").parquet(path)


def fingerprint(df: DataFrame) -> DataFrame:
    """(rows, digest): order-free content hash, one map-side combined pass."""
    row = F.xxhash64(*[C(c) for c in sorted(df.columns)])
    return df.agg(
        F.count("*").alias("rows"),
        F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest"),
    )


def write_if_changed(df: DataFrame, base: str) -> bool:
    """Replace the table at ``base`` only if the content differs.

    A version is written whole into its own folder; the pointer to it, one row,
    is replaced last.  Readers see the old or the new version, never a part.
    """
    spark = df.sparkSession
    now = fingerprint(df).first()
    before = read_or_empty(spark, f"{base}/current", "version string, rows bigint, digest string").first()
    if before and (before.rows, before.digest) == (now.rows, now.digest):
        return False
    version = uuid.uuid4().hex
    df.write.parquet(f"{base}/versions/{version}")
    pointer = spark.createDataFrame([(version, now.rows, now.digest)], "version string, rows bigint, digest string")
    pointer.coalesce(1).write.mode("overwrite").parquet(f"{base}/current")
    return True


def read_current(spark: SparkSession, base: str) -> DataFrame:
    version = spark.read.parquet(f"{base}/current").first().version
    return spark.read.parquet(f"{base}/versions/{version}")


def prune_orphans(stored: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Stored rows that the manifest still names; write the result over them."""
    return stored.join(manifest.select(key).distinct(), key, "left_semi")


def must_rebuild(sources: DataFrame, index_time: Column) -> DataFrame:
    """(source, modified, newer) plus whether any source is newer than the index.

    Input = (source, modified) with one row per file; files fold map side.
    """
    latest = sources.groupBy("source").agg(F.max("modified").alias("modified"))
    newer = C("modified") > index_time
    any_newer = scalar(sources, F.coalesce(F.bool_or(newer), F.lit(False)))
    return latest.select("source", "modified", newer.alias("newer"), any_newer.alias("rebuild"))


def file_times(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(source, modified) of the files below each path."""
    out: DataFrame | None = None
    for name, path in paths.items():
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        rows = files.select(F.lit(name).alias("source"), C("modificationTime").alias("modified"))
        out = rows if out is None else out.unionByName(rows)
    return out


def status_snapshot(now: Column, **sections: DataFrame) -> DataFrame:
    """One JSON document.  Each section is a one-row table, or a small table
    that becomes a list; section tables hold aggregates only."""
    spark = next(iter(sections.values())).sparkSession
    fields = [now.cast("string").alias("generated_at")]
    for name, df in sections.items():
        rows = df.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias("v"))
        fields.append(rows.select("v").scalar().alias(name))
    return spark.range(1).select(F.to_json(F.struct(*fields)).alias("value"))


def report_lines(title: str, **tables: DataFrame) -> DataFrame:
    """(section, line): tables of aggregates as rows of text, headings first."""
    out: DataFrame | None = None
    for no, (name, df) in enumerate(tables.items()):
        spark = df.sparkSession
        head = " | ".join(df.columns)
        top = spark.createDataFrame(
            [(no, name, 0, f"## {name}"), (no, name, 1, f"| {head} |")], "section int, name string, part int, line string"
        )
        cells = [F.coalesce(C(f"`{c}`").cast("string"), F.lit("—")) for c in df.columns]
        rows = df.select(
            F.lit(no).alias("section"), F.lit(name).alias("name"), F.lit(2).alias("part"),
            F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"),
        )
        both = top.unionByName(rows)
        out = both if out is None else out.unionByName(both)
    return out.withColumn("report", F.lit(title)).orderBy("section", "part", "line")


def read_ops_table(spark: SparkSession, path: str, columns: str | None = None) -> DataFrame:
    """An operational table with a fixed schema; 64-bit ids stay numbers."""
    return (spark.read.schema(columns) if columns else spark.read).parquet(path)


def read_ops_jdbc(spark: SparkSession, url: str, table: str, key: str, bounds: tuple[int, int], parts: int, **options) -> DataFrame:
    """The same table from a database, read in ``parts`` ranges of ``key``."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts, **options)
        .load()
    )
