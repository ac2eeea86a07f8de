"""Logs as Parquet tables, and the range source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def append(df: DataFrame, path: str) -> None:
    """Adds rows to the log at path; Spark's commit protocol makes the append whole or nothing."""
    df.write.mode("append").parquet(path)


def append_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream to the log at path, each micro-batch whole or not at all; checkpoint keeps how far it has come."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").start(path)


def scan(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the log; order is in its seq column, not in the files."""
    return spark.read.parquet(path)


def at(log: DataFrame, seq: str, value: int) -> DataFrame:
    """Point read by seq; the filter reaches the Parquet scan."""
    return log.where(log[seq] == value)
