"""Benchmarks beside the equal-weighted one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators.relational import asof_join


def latest_rate(dates: DataFrame, rates: DataFrame, on: str, day: str, rate: str, name: str = "rf") -> DataFrame:
    """``dates`` with the last rate dated before each; 0 where there is none.

    Rates of all dates are one series (a row a day), so the as-of join is one
    sorted sequence.
    """
    known = rates.filter(F.col(rate).isNotNull()).select(F.lit(0).alias("_one"), F.date_add(day, 1).alias("_from"), F.col(rate).alias(name))  # usable from the next day on
    out = asof_join(dates.withColumn("_one", F.lit(0)), known, ["_one"], on, "_from", [name])
    return out.withColumn(name, F.coalesce(name, F.lit(0.0))).drop("_one")


def cash_market_blend(rate: Column, market: Column, months: int, share: float = 0.5) -> Column:
    """A period's return of cash at a yearly rate and the market, mixed."""
    return share * (F.pow(1 + rate, F.lit(months / 12)) - 1) + (1 - share) * market
