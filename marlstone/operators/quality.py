"""Table verification, coverage and output validators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table_summary(df: DataFrame, key: str, on: str, values: Sequence[str] = ()) -> DataFrame:
    """Rows, distinct keys, first and last date, and the share of non-null values, in one pass."""
    cells = [F.count("*").alias("rows"), F.countDistinct(key).alias("keys"), F.min(on).alias("first"), F.max(on).alias("last")]
    cells += [F.round(F.try_divide(F.count(v), F.count("*")) * 100, 1).alias(f"pct_{v}") for v in values]
    return df.agg(*cells)


def field_breakdown(facts: DataFrame, field: str, value: str, key: str, on: str) -> DataFrame:
    """Per field: rows, non-null rows and share, distinct keys and their share of all keys, first and last date."""
    total = facts.agg(F.countDistinct(key).alias("_total"))
    per = facts.groupBy(field).agg(F.count("*").alias("rows"), F.count(value).alias("non_null"), F.countDistinct(key).alias("keys"), F.min(on).alias("first"), F.max(on).alias("last"))
    out = per.crossJoin(F.broadcast(total))  # one row
    return out.select(field, "rows", "non_null", F.round(F.col("non_null") / F.col("rows") * 100, 1).alias("pct_non_null"), "keys", F.round(F.try_divide(F.col("keys"), F.col("_total")) * 100, 1).alias("pct_keys"), "first", "last")


def deep_coverage(facts: DataFrame, key: str, on: str, least: int) -> DataFrame:
    """Keys with at least ``least`` distinct dates."""
    return facts.groupBy(key).agg(F.countDistinct(on).alias("dates")).filter(F.col("dates") >= least)


def price_quality(prices: DataFrame, close: str, high: str, low: str, volume: str) -> DataFrame:
    return prices.agg(F.count("*").alias("rows"), F.count_if(F.col(close).isNull()).alias("null_close"), F.count_if(F.col(high) < F.col(low)).alias("high_below_low"), F.count_if(F.col(volume) < 0).alias("negative_volume"))


def swapped_high_low(prices: DataFrame, high: str, low: str) -> DataFrame:
    """High and low exchanged where they are the wrong way round; a null leaves both."""
    both = F.col(high).isNotNull() & F.col(low).isNotNull()
    return prices.withColumns({high: F.when(both, F.greatest(high, low)).otherwise(F.col(high)), low: F.when(both, F.least(high, low)).otherwise(F.col(low))})


def validate_weights(books: DataFrame, weight: str, leg: str, by: Sequence[str], cap: float) -> DataFrame:
    """Per book: wrong signs, weights over the cap, and whether it is valid."""
    bad = F.count_if(((F.col(leg) == "long") & (F.col(weight) < 0)) | ((F.col(leg) == "short") & (F.col(weight) > 0)))
    over = F.count_if(F.abs(weight) > cap + 1e-9)
    return books.groupBy(*by).agg(bad.alias("wrong_sign"), over.alias("over_cap")).withColumn("valid", (F.col("wrong_sign") == 0) & (F.col("over_cap") == 0))


def validate_returns(series: DataFrame, ret: str, by: Sequence[str], most: float = 0.5) -> DataFrame:
    return series.groupBy(*by).agg(F.count("*").alias("rows"), F.count_if(F.col(ret).isNull() | F.isnan(ret)).alias("missing"), F.count_if(F.abs(ret) > most).alias("extreme"))


def success_rates(log: DataFrame, status: str, by: Sequence[str], good: Sequence[str]) -> DataFrame:
    n = F.count("*")
    return log.groupBy(*by).agg(n.alias("events"), F.count_if(F.col(status).isin(*good)).alias("good"), F.round(F.count_if(F.col(status).isin(*good)) / n * 100, 1).alias("pct_good"))


def content_print(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A fingerprint that doesn't depend on row order: rows, and sum and XOR of their hashes."""
    h = F.xxhash64(*columns)
    return df.agg(F.count("*").alias("rows"), F.sum(h.cast("decimal(38,0)")).alias("sum_hash"), F.bit_xor(h).alias("xor_hash"))


def liquidity_filter(adv: DataFrame, column: str, least: float, share: float = 0.15) -> DataFrame:
    """Rows at or above both the floor and the ``share`` quantile of the column."""
    cut = adv.agg(F.percentile(column, F.lit(share)).alias("_q"))  # one row
    return adv.crossJoin(F.broadcast(cut)).filter(F.col(column) >= F.greatest(F.lit(least), F.col("_q"))).drop("_q")


def company_summary(tables: dict[str, tuple[DataFrame, str, str]], key: str = "symbol") -> DataFrame:
    """Rows and first and last date of every entity in each table, given as name: (rows, key, date); an entity without rows isn't listed."""
    parts = [
        df.groupBy(F.col(k).alias(key)).agg(F.count("*").alias("records"), F.min(d).cast("date").alias("first_date"), F.max(d).cast("date").alias("last_date")).select(key, F.lit(name).alias("table_name"), "records", "first_date", "last_date")
        for name, (df, k, d) in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts).filter(F.col(key).isNotNull())


def rate_quality(rates: DataFrame, close: str) -> DataFrame:
    """Rows, rows without a rate and rows whose rate isn't positive."""
    return rates.agg(F.count("*").alias("total"), F.count_if(F.col(close).isNull()).alias("null_close"), F.count_if(F.col(close) <= 0).alias("non_positive_rate"))


def validate_factors(scores: DataFrame, factors: Sequence[str], by: Sequence[str], tolerance: float = 0.5) -> DataFrame:
    """Per factor: groups, groups whose mean is beyond the tolerance, and whether at most half of all are."""
    means = scores.groupBy(*by).agg(*[F.avg(f).alias(f) for f in factors])
    long = means.select(F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).alias("m")) for f in factors])).alias("x")).select("x.*")
    beyond = F.count_if(F.abs("m") > tolerance)
    return long.groupBy("factor").agg(F.count("*").alias("groups"), beyond.alias("beyond"), (beyond / F.count("*") <= 0.5).alias("passed"))


def validate_regimes(rows: DataFrame, percentile: str, regime: str, weights: Sequence[str], labels: Sequence[str] = ("LOW", "NORMAL", "HIGH"), tolerance: float = 1e-3) -> DataFrame:
    """Rows, and those with a percentile outside 0..1, an unknown label, or weights that don't add up to 1."""
    total = sum((F.coalesce(F.col(w), F.lit(0.0)) for w in weights), F.lit(0.0))
    inside = F.coalesce(F.col(percentile).between(0, 1), F.lit(False))
    known = F.coalesce(F.col(regime).isin(*labels), F.lit(False))
    bad = [F.count_if(~inside).alias("bad_percentile"), F.count_if(~known).alias("bad_label"), F.count_if(F.abs(total - 1) > tolerance).alias("bad_weights")]
    return rows.agg(F.count("*").alias("n"), *bad)
