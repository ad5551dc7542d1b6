"""Point-in-time lookups, as-of joins, upserts and first-wins choices."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ordered(df: DataFrame, order: Sequence[str | Column]) -> Column:
    return F.struct(*order)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the largest ``order`` of every key.

    ``max_by`` aggregates partially, so a key with very many rows sends one
    row per task; ``order`` must be total where ties matter.
    """
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the smallest ``order`` of every key."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def latest_rows(df: DataFrame, keys: Sequence[str], on: str, n: int) -> DataFrame:
    """The ``n`` rows of every key with the largest ``on``; a limited rank, so a key sends few rows from each task."""
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(on).desc()))
    return df.withColumn("_back", back).filter(F.col("_back") <= n).drop("_back")


def point_in_time(facts: DataFrame, keys: Sequence[str], on: str, order: Sequence[str], as_of: Sequence[date], lag_days: int = 0) -> DataFrame:
    """For every date of ``as_of``, each key's latest fact dated at most ``lag_days`` before it.

    A fact holds from its date until the key's next one. It is looked up in
    the calendar, a literal of a few hundred dates, by the two ends of that
    interval, so facts are shuffled once (by key) however many dates there are.
    """
    last = latest_per_key(facts, [*keys, on], order)
    until = F.lead(on).over(Window.partitionBy(*keys).orderBy(on))
    days = F.array(*[F.lit(d) for d in sorted(as_of)])
    held = last.withColumn("_until", until)
    cutoff = lambda d: F.date_sub(d, lag_days)
    dates = F.filter(days, lambda d: (cutoff(d) >= F.col(on)) & (F.col("_until").isNull() | (cutoff(d) < F.col("_until"))))
    return held.withColumn("as_of", F.explode(dates)).drop("_until")


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_on: str, right_on: str, values: Sequence[str], direction: str = "backward", then_other: bool = False) -> DataFrame:
    """Adds to every left row the values of the right row that is nearest in the given direction (same time included).

    Both sides are put in one sequence per key and the last (next) right row
    is carried along: one shuffle and one sort, no range join. With
    ``then_other``, rows without a match take the nearest one of the other side.
    """
    packed = F.struct(*values)
    rows_l = left.select(*keys, F.col(left_on).alias("_at"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_left"), F.lit(None).cast(right.select(packed).schema[0].dataType).alias("_right"))
    rows_r = right.select(*keys, F.col(right_on).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_left"), packed.alias("_right"))
    both = rows_l.unionByName(rows_r)
    order = Window.partitionBy(*keys)
    before = F.last("_right", ignorenulls=True).over(order.orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_right", ignorenulls=True).over(order.orderBy("_at", F.col("_side").desc()).rowsBetween(0, Window.unboundedFollowing))
    found = {"backward": [before, after], "forward": [after, before]}[direction]
    match = F.coalesce(*found) if then_other else found[0]
    out = both.withColumn("_match", match).filter("_side = 1")
    return out.select("_left.*", *[F.col(f"_match.{c}").alias(c) for c in values])


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], batch: str | None = None) -> DataFrame:
    """Rows of ``old`` replaced by those of ``new`` with their key; of several new ones the last ``batch`` wins."""
    new = latest_per_key(new, keys, [batch]) if batch else new
    kept = old.join(new.select(*keys), list(keys), "left_anti")
    return kept.unionByName(new.select(*old.columns))


def insert_absent(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``old`` and those rows of ``new`` whose key it lacks."""
    return old.unionByName(new.join(old.select(*keys).distinct(), list(keys), "left_anti").select(*old.columns))


def source_cascade(df: DataFrame, entity: Sequence[str], priority: str) -> DataFrame:
    """All rows of the first source (smallest ``priority``) that has any for the entity."""
    best = df.groupBy(*entity).agg(F.min(priority).alias("_best"))
    return df.join(best, list(entity)).filter(F.col(priority) == F.col("_best")).drop("_best")


def not_covered(active: DataFrame, covered: DataFrame, key: str) -> DataFrame:
    return active.join(covered.select(key).distinct(), key, "left_anti")


def aligned(new: DataFrame, old: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Keys of either side with both values, 0 where one has none."""
    a = new.select(*keys, F.col(value).alias("new"))
    b = old.select(*keys, F.col(value).alias("old"))
    return a.join(b, list(keys), "full_outer").select(*keys, F.coalesce("new", F.lit(0.0)).alias("new"), F.coalesce("old", F.lit(0.0)).alias("old"))


def dedupe_titles(news: DataFrame, title: str, order: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """The first row of every trimmed, lower-cased title; rows with a blank or null title all stay."""
    key = F.lower(F.trim(F.coalesce(F.col(title), F.lit(""))))
    blank = news.filter(key == "")
    named = news.filter(key != "").withColumn("_key", key)
    first = first_per_key(named, [*within, "_key"], order)
    return blank.unionByName(first.select(*news.columns))
