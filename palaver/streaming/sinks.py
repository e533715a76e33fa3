"""Stateless streams, joins of streams and per-batch merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.functions.text import redact_secrets
from palaver.operators.activity import log_keep
from palaver.session import scratch_table

C = F.col


def stream_table(spark: SparkSession, folder: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """One of the tables as a file stream, be it one file or a folder of part files.

    A table that does not exist raises, as it does when read as a batch.
    """
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{folder}/{name}.parque[t]")  # a pattern may match a file or a folder


def replay(df: DataFrame, name: str) -> DataFrame:
    """A derived table as a stream: written into the shared folder and read as it comes."""
    path = scratch_table(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).parquet(path)


def run_to_table(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Drain a stream into a Parquet table of the shared folder and read it."""
    spark = df.sparkSession
    path = scratch_table(spark, name)
    query = (
        df.writeStream.outputMode(mode).format("parquet").option("path", path)
        .option("checkpointLocation", scratch_table(spark, f"{name}-log")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def log_rows(records: DataFrame) -> DataFrame:
    """Log records worth keeping: noise dropped, credentials hidden, level cut."""
    return records.where(log_keep()).select(
        "id", "ts", F.substring("level", 1, 16).alias("level"), "logger",
        F.coalesce(redact_secrets(C("message")), F.lit("")).alias("message"),
    )


def message_table(records: DataFrame, name: str = "messages") -> DataFrame:
    """Drain a stream of messages into a table that holds each id once.

    A batch drops the ids that are stored already, however old the message is;
    a batch that runs again after a failure therefore adds nothing twice.
    """
    spark = records.sparkSession
    path, schema = scratch_table(spark, name), records.schema
    spark.createDataFrame([], schema).write.parquet(path)

    def merge(batch: DataFrame, epoch: int) -> None:
        known = batch.sparkSession.read.schema(schema).parquet(path).select("id")
        batch.dropDuplicates(["id"]).join(known, "id", "left_anti").select(*schema.names).write.mode("append").parquet(path)

    query = (
        records.writeStream.foreachBatch(merge)
        .option("checkpointLocation", scratch_table(spark, f"{name}-log")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(schema).parquet(path)


def vote_stream(answers: DataFrame, votes: DataFrame, within: str = "7 days", delay: str = "1 day") -> DataFrame:
    """Answers joined with the votes that follow within a time, as a stream.

    Two watermarks and the interval bound the state: a vote meets its answer at
    once, and an answer without a vote is given out when the watermark has
    passed its interval.  Times lie after 1970, where watermarks begin.
    """
    a = answers.select("chat_id", "message_id", "ts").withWatermark("ts", delay).alias("a")
    v = votes.select("chat_id", "message_id", "rating", "created_at").withWatermark("created_at", delay).alias("v")
    cond = F.expr(
        "a.chat_id = v.chat_id AND a.message_id = v.message_id "
        f"AND v.created_at >= a.ts AND v.created_at <= a.ts + INTERVAL {within}"
    )
    return a.join(v, cond, "left_outer").select("a.chat_id", "a.message_id", "a.ts", "v.rating", "v.created_at")


def answer_votes(answers: DataFrame, votes: DataFrame, within: str = "7 days", delay: str = "1 day") -> DataFrame:
    """Every answer with the votes that follow within a time, or without one.

    ``answers`` = (chat_id, message_id, ts), ``votes`` = (chat_id, message_id,
    rating, created_at), as streams.  What is still open when the streams have
    ended is read from the state of the join and closed without a vote.  Rows
    more than ``delay`` behind the latest of all earlier files come too late.
    """
    spark, joined = answers.sparkSession, vote_stream(answers, votes, within, delay)
    path, log = scratch_table(spark, "votes"), scratch_table(spark, "votes-log")
    query = joined.writeStream.format("parquet").option("path", path).option("checkpointLocation", log).trigger(availableNow=True).start()
    query.awaitTermination()
    if not any(p["numInputRows"] for p in query.recentProgress):
        return spark.createDataFrame([], joined.schema)
    done = spark.read.schema(joined.schema).parquet(path)
    state = spark.read.format("statestore").option("storeName", "left-keyWithIndexToValue").load(log)
    none = [F.lit(None).cast(joined.schema[c].dataType).alias(c) for c in ("rating", "created_at")]
    return done.unionByName(state.where("NOT value.matched").select("value.chat_id", "value.message_id", "value.ts", *none))


def registry_merge(state: str):
    """``foreachBatch`` function that adds a batch's part to a table of users.

    A batch writes one row for each user it has seen into a folder of its own,
    so its work does not grow with the table, and a batch that is run again
    after a failure replaces its own part only.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        new = batch.groupBy("user_id").agg(
            F.count("*").alias("query_count"), F.min("ts").alias("joined_at"), F.max("ts").alias("last_active_at")
        )
        new.write.mode("overwrite").parquet(f"{state}/epoch={epoch}")

    return merge


def registry(parts: DataFrame) -> DataFrame:
    """The table of users from its parts; also what a compaction of old parts writes."""
    return parts.groupBy("user_id").agg(
        F.sum("query_count").alias("query_count"), F.min("joined_at").alias("joined_at"), F.max("last_active_at").alias("last_active_at")
    )


def user_registry(events: DataFrame) -> DataFrame:
    """Run the registry over a stream of (user_id, ts) and return the table."""
    spark = events.sparkSession
    state = scratch_table(spark, "users")
    query = (
        events.writeStream.foreachBatch(registry_merge(state))
        .option("checkpointLocation", scratch_table(spark, "users-log")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    schema = "user_id bigint, query_count bigint, joined_at timestamp, last_active_at timestamp"
    return registry(spark.read.schema(schema).option("recursiveFileLookup", True).parquet(state))


def latest_windows(windows: DataFrame, key: str, name: str) -> DataFrame:
    """Drain a windowed aggregate in update mode and read its windows as last written.

    A batch writes only the windows it has changed, late rows among them, into a
    folder of its own; a batch that runs again replaces its own folder.
    """
    spark, path = windows.sparkSession, scratch_table(windows.sparkSession, name)
    others = [c for c in windows.columns if c != key]

    def merge(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    query = (
        windows.writeStream.outputMode("update").foreachBatch(merge)
        .option("checkpointLocation", scratch_table(spark, f"{name}-log")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    if not any(p["numInputRows"] for p in query.recentProgress):
        return spark.createDataFrame([], windows.schema)
    rows = spark.read.parquet(path).groupBy(key).agg(F.max_by(F.struct(*others), "epoch").alias("_last"))
    return rows.select(key, *[C(f"_last.{c}").alias(c) for c in others])
