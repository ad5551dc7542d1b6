"""Panels of prices and series of returns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _upto(by: Sequence[str], on: str) -> Window:
    return Window.partitionBy(*by).orderBy(on).rowsBetween(Window.unboundedPreceding, 0)


def month_panel(prices: DataFrame, symbol: str = "symbol", month: str = "month") -> DataFrame:
    """Every symbol in every month of the panel, with null where it has no price; ``row`` counts the panel's months.

    The months come from two scalars, so the grid is made by exploding a
    sequence per symbol instead of a cross join with a calendar.
    """
    span = prices.agg(F.min(month).alias("_lo"), F.max(month).alias("_hi")).first()
    if span["_lo"] is None:
        return prices.withColumn("row", F.lit(0))
    months = F.sequence(F.lit(span["_lo"]), F.lit(span["_hi"]), F.expr("interval 1 month"))
    grid = prices.select(symbol).distinct().select(symbol, F.posexplode(months).alias("row", month))
    return grid.join(prices, [symbol, month], "left")


def padded_panel(prices: DataFrame, value: str, symbol: str = "symbol", month: str = "month") -> DataFrame:
    """``month_panel`` with ``value`` carried forward over months without one; other columns are null there.

    A symbol's row stands for the months until its next row, its first one also for those
    before, so the panel takes one shuffle by symbol and no join.
    """
    span = prices.agg(F.min(month).alias("_lo"), F.max(month).alias("_hi")).first()
    if span["_lo"] is None:
        return prices.withColumn("row", F.lit(0))
    w = Window.partitionBy(symbol).orderBy(month)
    lo, hi = F.lit(span["_lo"]), F.lit(span["_hi"])
    others = [c for c in prices.columns if c not in (symbol, month, value)]
    own = F.when(F.col(symbol).isNotNull(), F.col(month))
    held = F.last(F.when(own.isNotNull(), F.col(value)), ignorenulls=True).over(_upto([symbol], month))
    first = F.when(F.row_number().over(w) == 1, lo).otherwise(F.col(month))
    final = F.coalesce(F.add_months(F.lead(month).over(w), -1), hi)
    spans = prices.select(symbol, own.alias("_own"), held.alias(value), *others, first.alias("_first"), final.alias("_final")).filter("_first <= _final")
    rows = spans.withColumn(month, F.explode(F.sequence("_first", "_final", F.expr("interval 1 month"))))
    at = F.col(month)
    number = (F.year(at) - span["_lo"].year) * 12 + F.month(at) - span["_lo"].month
    return rows.select(symbol, number.alias("row"), month, F.when(at >= F.col("_own"), F.col(value)).alias(value), *[F.when(at == F.col("_own"), F.col(c)).alias(c) for c in others])


def padded(panel: DataFrame, value: str, by: Sequence[str], on: str) -> DataFrame:
    """``value`` carried forward over nulls."""
    return panel.withColumn(value, F.last(value, ignorenulls=True).over(_upto(by, on)))


def simple_returns(panel: DataFrame, value: str, by: Sequence[str], on: str, name: str = "ret") -> DataFrame:
    """Change against the panel's previous row, on padded values."""
    return changes(padded(panel, value, by, on), value, by, on, name)


def changes(panel: DataFrame, value: str, by: Sequence[str], on: str, name: str = "ret") -> DataFrame:
    """Change against the panel's previous row."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(on))
    return panel.withColumn(name, F.try_divide(F.col(value), before) - 1)


def momentum(panel: DataFrame, value: str, by: Sequence[str], on: str, lookback: int = 12, skip: int = 1, name: str = "momentum") -> DataFrame:
    """value[-skip] / value[-lookback] - 1 by rows of the panel, null where it is shorter."""
    w = Window.partitionBy(*by).orderBy(on)
    return panel.withColumn(name, F.try_divide(F.lag(value, skip).over(w), F.lag(value, lookback).over(w)) - 1)


def usd_returns(returns: DataFrame, ret: str, fx_ret: str, name: str = "usd_ret") -> DataFrame:
    return returns.withColumn(name, (1 + F.col(ret)) * (1 + F.coalesce(F.col(fx_ret), F.lit(0.0))) - 1)


def cumulative_growth(ret: Column, by: Sequence[str], on: str) -> Column:
    """The product of 1 + r up to each row; null counts as 0."""
    return F.product(1 + F.coalesce(ret, F.lit(0.0))).over(_upto(by, on))


def drawdowns(series: DataFrame, ret: str, by: Sequence[str], on: str) -> DataFrame:
    """Adds nav and drawdown; the peak starts at the first value."""
    grown = series.withColumn("nav", cumulative_growth(F.col(ret), by, on))
    return grown.withColumn("drawdown", F.col("nav") / F.max("nav").over(_upto(by, on)) - 1)


def drawdown_durations(series: DataFrame, ret: str, by: Sequence[str], on: str) -> DataFrame:
    """Per group: max_drawdown, trough, and months from the trough to the first recovery (or the end)."""
    dd = drawdowns(series, ret, by, on)
    trough = dd.groupBy(*by).agg(F.min("drawdown").alias("max_drawdown"), F.min_by(on, F.struct("drawdown", on)).alias("trough"), F.max(on).alias("_end"))
    back = dd.join(trough, list(by)).filter((F.col(on) > F.col("trough")) & (F.col("drawdown") >= -1e-8)).groupBy(*by).agg(F.min(on).alias("_back"))
    months = lambda c: F.year(c) * 12 + F.month(c)
    out = trough.join(back, list(by), "left")
    return out.select(*by, "max_drawdown", "trough", (months(F.coalesce("_back", "_end")) - months(F.col("trough"))).alias("duration_months"))


def rolling(series: DataFrame, value: str, by: Sequence[str], on: str, rows: int) -> DataFrame:
    """Rolling mean, sample deviation and annualised ratio over ``rows`` rows; null until there are as many."""
    w = Window.partitionBy(*by).orderBy(on).rowsBetween(-(rows - 1), 0)
    full = F.count(value).over(w) >= rows
    mean, sd = F.avg(value).over(w), F.stddev_samp(value).over(w)
    return (
        series.withColumn("roll_mean", F.when(full, mean))
        .withColumn("roll_std", F.when(full, sd))
        .withColumn("roll_sharpe", F.try_divide(F.col("roll_mean") * 12, F.nullif(F.col("roll_std") * 12**0.5, F.lit(0.0))))
    )


def rank_pct(value: str, by: Sequence[str]) -> Column:
    """Average rank of ties over the number of rows."""
    w = Window.partitionBy(*by)
    ties = Window.partitionBy(*by, value)
    return (F.rank().over(w.orderBy(value)) + (F.count("*").over(ties) - 1) / 2) / F.count("*").over(w)


def regimes(series: DataFrame, value: str, on: str, by: Sequence[str] = (), least: int = 20, low: float = 0.30, high: float = 0.80) -> DataFrame:
    """For every date: the percentile of its value among all values so far, and the regime it means.

    A value's rank among those before it is counted as in a merge sort: for
    each power of two, rows of the second half of a block of dates count the first
    half's lesser values. A row takes part once for each power (n log n rows in
    all, dealt by block), and no row holds another's values. Null values
    are under none and above none.
    """
    order = Window.partitionBy(*(by or [F.lit(0)])).orderBy(on)
    rows = series.select(*by, on, value).withColumn("_i", (F.row_number().over(order) - 1).cast("long"))
    last = F.max("_i").over(Window.partitionBy(*(by or [F.lit(0)])))
    levels = F.when(last > 0, F.sequence(F.lit(0), F.length(F.bin(last)) - 1)).otherwise(F.array(F.lit(0)))
    merged = rows.withColumn("_levels", levels).withColumn("_level", F.explode("_levels"))
    merged = merged.withColumn("_left", F.expr(f"(shiftright(_i, _level) & 1) = 0 and `{value}` is not null").cast("long")).withColumn("_block", F.expr("shiftright(_i, _level + 1)"))
    block = Window.partitionBy(*by, "_level", "_block")
    same_here = F.sum("_left").over(Window.partitionBy(*by, "_level", "_block", value))
    upto = F.sum("_left").over(block.orderBy(value))
    right = F.expr(f"(shiftright(_i, _level) & 1) = 1 and `{value}` is not null")
    counted = merged.withColumns({"_under": F.when(right, upto - same_here).otherwise(0), "_same": F.when(right, same_here).otherwise(0)})
    found = counted.groupBy(*by, on, value, "_i").agg(F.sum("_under").alias("_under"), (F.sum("_same") + F.col(value).isNotNull().cast("int")).alias("_same"))
    pct = F.when(F.col("_i") + 1 >= least, (F.col("_under") + (F.col("_same") + 1) / 2) / (F.col("_i") + 1)).otherwise(0.5)
    out = found.select(*by, on, value, pct.alias("percentile"), (F.col("_i") + 1 >= least).alias("_enough"))
    name = F.when(~F.col("_enough"), "NORMAL").when(F.col("percentile") < low, "LOW").when(F.col("percentile") > high, "HIGH").otherwise("NORMAL")
    return out.withColumn("regime", name).drop("_enough")


def islands(series: DataFrame, label: str, by: Sequence[str], on: str) -> DataFrame:
    """Contiguous spans of one label: start, end and rows."""
    w = Window.partitionBy(*by).orderBy(on)
    changed = (F.lag(label).over(w).isNull() | (F.lag(label).over(w) != F.col(label))).cast("int")
    runs = series.withColumn("_c", changed).withColumn("_run", F.sum("_c").over(_upto(by, on)))
    return runs.groupBy(*by, "_run", label).agg(F.min(on).alias("start"), F.max(on).alias("end"), F.count("*").alias("rows")).drop("_run")


def growth(series: DataFrame, value: str, by: Sequence[str], on: str, name: str = "growth") -> DataFrame:
    """(cur - prev) / |prev| against the previous row; null where |prev| <= 0.001 or the change is 100-fold."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(on))
    change = F.try_divide(F.col(value) - before, F.abs(before))
    return series.withColumn(name, F.when((F.abs(before) > 0.001) & (F.abs(change) < 100), change))


def trailing_z(series: DataFrame, value: str, by: Sequence[str], on: str, rows: int = 252, more_than: int = 10, name: str = "z") -> DataFrame:
    """(x - mean) / max(sd, 1e-6) over the last ``rows`` rows, itself included."""
    w = Window.partitionBy(*by).orderBy(on).rowsBetween(-(rows - 1), 0)
    z = (F.col(value) - F.avg(value).over(w)) / F.greatest(F.stddev_samp(value).over(w), F.lit(1e-6))
    return series.withColumn(name, F.when(F.count(value).over(w) > more_than, z))


def quarters(span: DataFrame, first: str, last: str) -> DataFrame:
    """(quarter_start, quarter_end, middle) of every calendar quarter between the dates of one row."""
    starts = F.explode(F.sequence(F.trunc(first, "quarter"), F.trunc(last, "quarter"), F.expr("interval 3 months")))
    out = span.select(starts.alias("quarter_start")).withColumn("quarter_end", F.last_day(F.add_months("quarter_start", 2)))
    return out.withColumn("middle", F.date_add("quarter_start", F.floor(F.datediff("quarter_end", "quarter_start") / 2).cast("int")))
