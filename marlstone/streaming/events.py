"""JSON events through Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def keyed_messages(rows: DataFrame, key: str) -> DataFrame:
    """Rows as keyed JSON messages, the form that topics hold."""
    return rows.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*rows.columns)).alias("value"))


def read_messages(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """A stream over message files; each trigger takes a bounded number of them."""
    return spark.readStream.schema("key string, value string").option("maxFilesPerTrigger", max_files).parquet(folder)


def decoded(messages: DataFrame, schema: str) -> DataFrame:
    """Messages as columns; those that aren't JSON of that schema are skipped."""
    row = F.from_json("value", schema)
    return messages.withColumn("_row", row).filter("_row is not null").select("key", "_row.*")


def consume(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Everything that is there now goes to ``handle`` in batches; the checkpoint remembers what has been read."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly_counts(events: DataFrame, on: str = "ts", late: str = "1 hour") -> DataFrame:
    """Counts and sums per hour and type, with a watermark for late rows (an extension)."""
    return events.withWatermark(on, late).groupBy(F.window(on, "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("hour"), "event_type", "n", "total")
