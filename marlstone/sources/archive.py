"""An archive of documents without a schema: stored as variants, found by conditions on paths."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_PARTS = r'"(?:[^"\\]|\\.)*"|[^"]+|"'


def sanitised(text: Column | str) -> Column:
    """JSON text whose NaN and infinite numbers, outside of strings, are null."""
    text = F.col(text) if isinstance(text, str) else text
    parts = F.regexp_extract_all(text, F.lit(_PARTS), F.lit(0))
    clean = F.transform(parts, lambda p: F.when(p.startswith('"'), p).otherwise(F.regexp_replace(p, r"-?\b(?:Infinity|NaN)\b", "null")))
    return F.array_join(clean, "")


def documents(raw: DataFrame, text: str = "value") -> DataFrame:
    """``raw`` with doc (a variant) and ingested_at; doc is null where the text is no JSON."""
    return raw.withColumn("doc", F.try_parse_json(sanitised(text))).withColumn("ingested_at", F.current_timestamp())


def insert(raw: DataFrame, path: str, text: str = "value") -> None:
    """Appends the documents of ``raw`` to the archive at ``path``, with the columns beside them; texts that are no JSON are kept as ``rejected``."""
    docs = documents(raw, text)
    docs.withColumn("rejected", F.when(F.col("doc").isNull(), F.col(text))).drop(text).write.mode("append").parquet(path)


def at(path: str, kind: str, doc: str = "doc") -> Column:
    """The value at a dotted path, as ``kind``; null where there is none or another kind. Numbers in brackets index arrays."""
    return F.try_variant_get(doc, f"$.{path}" if path else "$", kind)


def _kind(value: Any) -> str:
    return "boolean" if isinstance(value, bool) else "double" if isinstance(value, (int, float)) else "string"


def condition(query: Mapping[str, Any], doc: str = "doc") -> Column:
    """A condition from {path: value} or {path: {operator: value}}; all must hold.

    Operators are $eq, $ne, $gt, $gte, $lt, $lte, $in and $exists. A path that
    isn't there satisfies only $ne and $exists: false.
    """
    holds = F.lit(True)
    for path, wanted in query.items():
        for operator, value in (wanted if isinstance(wanted, Mapping) else {"$eq": wanted}).items():
            if operator == "$exists":
                there = F.try_variant_get(doc, f"$.{path}", "variant").isNotNull()
                holds = holds & (there if value else ~there)
                continue
            one = value[0] if operator == "$in" else value
            found = at(path, _kind(one), doc)
            tests = {"$eq": lambda: found == value, "$ne": lambda: ~found.eqNullSafe(F.lit(value)), "$gt": lambda: found > value, "$gte": lambda: found >= value, "$lt": lambda: found < value, "$lte": lambda: found <= value, "$in": lambda: found.isin(*value)}
            if operator not in tests:
                raise ValueError(f"unknown operator {operator!r}")
            holds = holds & F.coalesce(tests[operator](), F.lit(False))
    return holds


def find(spark: SparkSession, path: str, query: Mapping[str, Any], limit: int = 0) -> DataFrame:
    """Documents of the archive for which the query holds; ``limit`` 0 means all of them."""
    found = spark.read.parquet(path).filter("rejected IS NULL").filter(condition(query))
    return found.limit(limit) if limit else found
