"""Incremental runs: only new or changed files, and late deliveries, as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marginalia.operators.extract import comments


def new_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files (path, content_hash, ...) whose content is not known yet under their path."""
    return files.join(known.select("path", "content_hash"), ["path", "content_hash"], "left_anti")


def stream_comments(spark: SparkSession, source: str, target: str, state: str, schema: str = "path STRING, language STRING, text STRING") -> StreamingQuery:
    """Comments of the files that arrive as Parquet in `source`, appended to `target`; ends when all are read.

    Each batch is written under its number, so that a batch which is run again after a failure replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        comments(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    files = spark.readStream.schema(schema).parquet(source)
    return files.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()


def first_deliveries(stream: DataFrame, key: list[str], at: str, lateness: str) -> DataFrame:
    """A stream without repeated deliveries: of each key the first within the watermark of event time `at`."""
    return stream.withWatermark(at, lateness).dropDuplicatesWithinWatermark(key)


def counts_by_time(stream: DataFrame, at: str, width: str, lateness: str, by: list[str]) -> DataFrame:
    """Counts per window of event time and key; late rows count until the watermark passes their window."""
    grouped = stream.withWatermark(at, lateness).groupBy(F.window(at, width).alias("w"), *by)
    return grouped.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], state: str, mode: str = "append") -> StreamingQuery:
    return stream.writeStream.outputMode(mode).foreachBatch(work).option("checkpointLocation", state).trigger(availableNow=True).start()
