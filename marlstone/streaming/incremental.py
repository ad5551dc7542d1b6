"""Incremental loads with watermarks and an audit log, each row once however often a run is tried again."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Days that a run of each frequency looks back (fixed values).
LOOKBACK = {"daily": 5, "weekly": 14, "monthly": 35, "quarterly": 95}
_ERROR_CHARS = 500


def date_range(end: date, frequency: str | None = None, years: int = 5) -> tuple[date, date]:
    """First and last day of a load: the frequency's days back, or so many years of 365 days for a first load."""
    return end - timedelta(days=LOOKBACK[frequency] if frequency in LOOKBACK else 365 * years), end


def log_rows(rows: DataFrame, run_id: Column | str, frequency: str, by: Sequence[str], status: Column, error: Column, on: str) -> DataFrame:
    """Audit rows: one for each key and status of ``rows``, with counts, the span of dates and the first error's first 500 characters."""
    return rows.withColumns({"status": status, "_e": error}).groupBy(*by, "status").agg(
        F.lit(run_id).cast("string").alias("run_id") if isinstance(run_id, str) else F.first(run_id).alias("run_id"),
        F.count("*").alias("rows_affected"),
        F.substring(F.min("_e"), 1, _ERROR_CHARS).alias("error_message"),
        F.lit(frequency).alias("run_frequency"),
        F.min(on).alias("date_range_start"),
        F.max(on).alias("date_range_end"),
    )


class IncrementalStore:
    """Facts, watermarks and an audit log in one shared folder, filled by runs of a file stream.

    A run takes the files that no run before it has taken; the stream's
    checkpoint knows them. What it writes goes to partitions named by its
    batch, in whole, so a run that failed half-way and is tried again replaces
    its own rows and no others: every row counts once. A batch reads the
    watermarks of the batches before it and never its own.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, by: Sequence[str], on: str, frequency: str = "daily"):
        self.spark, self.folder, self.schema, self.by, self.on, self.frequency = spark, folder, schema, list(by), on, frequency

    def _table(self, name: str) -> DataFrame | None:
        path = f"{self.folder}/{name}"
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return None
        return self.spark.read.parquet(path)

    def facts(self) -> DataFrame | None:
        return self._table("facts")

    def log(self) -> DataFrame | None:
        return self._table("log")

    def watermarks(self, before: int | None = None) -> DataFrame | None:
        """(by, last_success): the last date that was loaded for each key, by batches before ``before``."""
        marks = self._table("watermarks")
        if marks is None:
            return None
        return (marks if before is None else marks.filter(F.col("batch") < before)).groupBy(*self.by).agg(F.max("last_success").alias("last_success"))

    def _write(self, df: DataFrame, name: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch}")

    def _load(self, rows: DataFrame, batch: int, valid: Callable[[], Column]) -> None:
        known = self.watermarks(before=batch)
        if known is None:
            known = self.spark.createDataFrame([], T.StructType([*(self.schema[c] for c in self.by), T.StructField("last_success", T.DateType())]))
        floor = F.date_sub("last_success", LOOKBACK[self.frequency])
        # the watermark table has a row for each key; both sides are dealt by it
        seen = rows.join(known, self.by, "left").withColumn("_good", F.coalesce(valid(), F.lit(False)))
        status = F.when(~F.col("_good"), "FAILED").when(F.col(self.on) < floor, "SKIPPED").otherwise("SUCCESS")
        judged = seen.withColumn("_status", status)
        error = F.when(F.col("_status") == "FAILED", F.concat(F.lit("invalid row: "), F.to_json(F.struct(*self.schema.names))))
        loaded = judged.filter("_status = 'SUCCESS'")
        self._write(loaded.select(*self.schema.names), "facts", batch)
        self._write(log_rows(judged, str(batch), self.frequency, self.by, F.col("_status"), error, self.on), "log", batch)
        self._write(loaded.groupBy(*self.by).agg(F.max(self.on).cast("date").alias("last_success")), "watermarks", batch)

    def run(self, source: str, valid: Callable[[], Column]) -> None:
        """Loads what is new under ``source`` (a folder of Parquet files): rows for which ``valid`` and that aren't older than the watermark less the frequency's days."""
        stream = self.spark.readStream.schema(self.schema).parquet(source)
        query = stream.writeStream.foreachBatch(lambda rows, batch: self._load(rows, batch, valid)).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()


def latest_facts(facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Facts of which a later batch has the key again only in that batch's version."""
    rest = [c for c in facts.columns if c not in keys]
    return facts.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest if c != "batch"])


def run_metrics(log: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per key: attempts, rows by status, and the share of rows that were loaded."""
    rows = lambda s: F.coalesce(F.sum(F.when(F.col("status") == s, F.col("rows_affected"))), F.lit(0))
    total = F.sum("rows_affected")
    return log.groupBy(*by).agg(F.count("*").alias("entries"), rows("SUCCESS").alias("loaded"), rows("SKIPPED").alias("skipped"), rows("FAILED").alias("failed"), F.round(100 * rows("SUCCESS") / total, 1).alias("pct_loaded"))
