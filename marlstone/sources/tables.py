"""Reading the driver's tables and writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by name; unknown names are refused, so that names from outside can't reach other paths."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def missing_columns(df: DataFrame, expected: list[str]) -> list[str]:
    return sorted(set(expected) - set(df.columns))


def export_rows(df: DataFrame, key: str, value: str, on: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows of one key, with an optional range of dates, in date order; the range reaches the scan."""
    out = df.filter(F.trim(F.col(key).cast("string")) == value)
    if start:
        out = out.filter(F.col(on) >= F.lit(start).cast("date"))
    if end:
        out = out.filter(F.col(on) <= F.lit(end).cast("date"))
    return out.orderBy(on)


def as_json(df: DataFrame, name: str = "value") -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns), {"dateFormat": "yyyy-MM-dd"}).alias(name))


def save(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
