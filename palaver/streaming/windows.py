"""Windowed aggregates; the same functions serve tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.operators.activity import count_if

C = F.col


def watermarked(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """A watermark bounds the state of a stream; a table needs none."""
    return df.withWatermark(ts, delay) if df.isStreaming else df


def _zoned(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.withColumn(ts, C(ts).cast("timestamp"))


def daily_questions(turns: DataFrame, delay: str = "1 day") -> DataFrame:
    """Questions per UTC day; days without any are absent."""
    asked = watermarked(_zoned(turns.where(C("role") == "user")), "ts", delay)
    return (
        asked.groupBy(F.window("ts", "1 day").alias("w"))
        .agg(F.count("*").alias("n"))
        .select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "n")
    )


def rolling_log_health(oplog: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Errors and warnings of the 24 hours before each full hour."""
    logs = watermarked(_zoned(oplog), "ts", delay)
    return (
        logs.groupBy(F.window("ts", "24 hours", "1 hour").alias("w"))
        .agg(
            count_if(C("level").isin("ERROR", "CRITICAL")).alias("errors"),
            count_if(C("level") == "WARNING").alias("warnings"),
            F.count("*").alias("n"),
        )
        .select(C("w.end").alias("window_end"), "errors", "warnings", "n")
    )


def rolling_answer_health(turns: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Answers and approximate latency quantiles of the last 24 hours, hourly."""
    answers = watermarked(_zoned(turns.where(C("role") == "assistant")), "ts", delay)
    return (
        answers.groupBy(F.window("ts", "24 hours", "1 hour").alias("w"))
        .agg(
            F.count("*").alias("answers"),
            F.max("latency_ms").alias("max_ms"),
            F.percentile_approx("latency_ms", [0.5, 0.95]).alias("q"),
        )
        .select(C("w.end").alias("window_end"), "answers", "max_ms", C("q")[0].alias("p50_ms"), C("q")[1].alias("p95_ms"))
    )
