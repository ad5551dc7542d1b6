"""Risk overlay of a book: trailing value at risk, volatility target and drawdown control, with the NAV they make fed back."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.portfolio import book_changes, tail_risk, vol_scalar

#: What a drawdown leaves of a book's exposure, by level: none to speak of, soft, hard (fixed values).
LEVELS = (1.0, 0.75, 0.5)


def trailing_book_returns(book: DataFrame, daily: DataFrame, by: Sequence[str], on: str, days: int = 1096, names: int = 2000) -> DataFrame:
    """(by, on, day, r): what a book would have returned on each of the ``days`` before its date, a missing return as 0.

    ``book`` has (by, on, symbol, weight), ``daily`` (symbol, day, ret). Both
    are dealt by symbol into blocks of about ``names``, and a block's weights (books x
    symbols) times its returns (symbols x days) is its part of every book's
    days: a daily row is not repeated for the dates and books that look back on it.
    """
    blocks = max(1, -(-book.agg(F.approx_count_distinct("symbol")).first()[0] // names))
    block = F.pmod(F.xxhash64("symbol"), F.lit(blocks)).alias("_block")
    held = book.filter(F.col("symbol").isNotNull() & F.col(on).isNotNull()).select(block, *by, on, F.unix_date(on).alias("_on"), "symbol", F.col("weight").cast("double").alias("weight"))
    paid = daily.filter("symbol is not null and day is not null").select(block, "symbol", F.unix_date("day").alias("day"), F.coalesce(F.col("ret").cast("double"), F.lit(0.0)).alias("ret"))

    def part(_, b: pa.Table, d: pa.Table) -> pa.Table:
        if not len(b) or not len(d):
            return pa.table({**{c: b[c].slice(0, 0) for c in (*by, on)}, "day": pa.array([], pa.date32()), "r": pa.array([], pa.float64())})
        codes = [np.asarray(b[c].combine_chunks().dictionary_encode().indices.fill_null(-1)) for c in by]
        _, first, row = np.unique(np.column_stack([*codes, np.asarray(b["_on"])]), axis=0, return_index=True, return_inverse=True)
        row, keys = row.ravel(), b.select([*by, on]).take(pa.array(first))
        symbols = b["symbol"].combine_chunks().unique()
        name, other = (np.asarray(pc.fill_null(pc.index_in(x["symbol"].combine_chunks(), symbols), -1)) for x in (b, d))
        d, other = d.filter(pa.array(other >= 0)), other[other >= 0]
        seen, day = np.unique(np.asarray(d["day"]), return_inverse=True)
        weight, ret = np.asarray(b["weight"]), np.asarray(d["ret"])
        w, r = np.zeros((len(first), len(symbols))), np.zeros((len(symbols), len(seen)))
        there = [np.zeros(m.shape, np.float32) for m in (w, r)]
        np.add.at(w, (row, name), weight)
        np.add.at(r, (other, day), ret)
        there[0][row, name], there[1][other, day] = 1, 1
        # what isn't a finite number stays with its own symbol's books and days
        odd = np.flatnonzero(~(np.isfinite(w).all(axis=0) & np.isfinite(r).all(axis=1)))
        out = np.delete(w, odd, axis=1) @ np.delete(r, odd, axis=0)
        for k in odd:
            rows, columns = np.flatnonzero(there[0][:, k]), np.flatnonzero(there[1][k])
            out[np.ix_(rows, columns)] += np.outer(w[rows, k], r[k, columns])
        since = np.asarray(b["_on"])[first][:, None] - seen[None, :]
        i, j = np.nonzero((there[0] @ there[1] > 0) & (since > 0) & (since <= days))
        keys = keys.take(pa.array(i))
        return pa.table({**{c: keys[c] for c in (*by, on)}, "day": pa.array(seen[j].astype("int32")).cast(pa.date32()), "r": pa.array(out[i, j])})

    kinds = {f.name: f.dataType.simpleString() for f in book.schema}
    parts = held.groupBy("_block").cogroup(paid.groupBy("_block")).applyInArrow(part, ", ".join([*(f"`{c}` {kinds[c]}" for c in (*by, on)), "day date, r double"]))
    return parts.groupBy(*by, on, "day").agg(F.sum("r").alias("r"))


def risk_scalars(trail: DataFrame, by: Sequence[str], budget: float = 0.02, target: float = 0.10, recent: int = 60, confidence: float = 0.99) -> DataFrame:
    """(by, n, var, es, var_scalar, vol_scalar) of trailing daily returns ``r``: budget / VaR, and target / deviation of the last ``recent`` days."""
    back = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("day").desc()))
    late = trail.withColumn("_b", back).filter(F.col("_b") <= recent).groupBy(*by).agg(F.stddev_samp("r").alias("_sd"), F.count("r").alias("_n"))
    tails = tail_risk(trail, "r", by, confidence=confidence).join(late, list(by))
    sd = F.when(F.col("_sd") > 0, F.col("_sd"))
    return tails.select(
        *by,
        "n",
        "var",
        "es",
        F.when(F.col("var") > 0, F.lit(budget) / F.col("var")).otherwise(1.0).alias("var_scalar"),
        vol_scalar(sd, F.col("_n"), target=target).alias("vol_scalar"),
    )


def overlay_steps(book: DataFrame, ahead: DataFrame, scalars: DataFrame, by: Sequence[str], on: str, k: str, ceiling: float = 2.0, most_gross: float = 2.0) -> DataFrame:
    """(by, on, k, gross_ret, scales, turnovers): all that a date's net return can be, before it is known how deep the drawdown is.

    A date's scale is VaR scalar x volatility scalar x one of ``LEVELS``, within
    0 and ``ceiling`` and so that gross exposure stays under ``most_gross``. Turnover depends on the
    levels of a date and of the one before: all pairs are summed here, set-wise,
    and the sequential pass only picks. ``book`` has (by, on, k, symbol, weight) with ``k``
    numbering dates without gaps; ``ahead`` (symbol, on, y); dates without scalars count as 1.
    """
    keys = [*by, k]
    dates = book.join(ahead.select("symbol", on, "y"), ["symbol", on], "left").groupBy(*by, on, k).agg(
        F.sum(F.col("weight") * F.coalesce("y", F.lit(0.0))).alias("gross_ret"), F.sum(F.abs("weight")).alias("_gross")
    )
    base = F.coalesce(F.col("var_scalar") * F.col("vol_scalar"), F.lit(1.0))

    def scale(level: float) -> Column:
        own = F.greatest(F.least(base * level, F.lit(ceiling)), F.lit(0.0))
        return F.least(own, F.coalesce(F.try_divide(F.lit(most_gross), F.col("_gross")), own))

    dates = dates.join(scalars, [*by, on], "left").select(*by, on, k, "gross_ret", F.array(*map(scale, LEVELS)).alias("scales"))
    now, before = dates.select(*keys, F.col("scales").alias("_now")), dates.select(*by, (F.col(k) + 1).alias(k), F.col("scales").alias("_was"))
    changes = book_changes(book, "weight", by, "symbol", k).join(F.broadcast(now), keys).join(F.broadcast(before), keys, "left")
    was = lambda j: F.coalesce(F.get("_was", F.lit(j)), F.lit(0.0))
    cell = lambda i, j: F.sum(F.abs(F.col("new") * F.get("_now", F.lit(i)) - F.col("old") * was(j))) / 2
    pairs = F.array(*[F.array(*[cell(i, j) for j in range(len(LEVELS))]) for i in range(len(LEVELS))])
    return dates.join(changes.groupBy(*keys).agg(pairs.alias("turnovers")), keys)


def overlaid(steps: DataFrame, by: Sequence[str], on: str, k: str, soft: float = -0.03, hard: float = -0.06, rows: int = 12, basis_points: float = 20) -> DataFrame:
    """(by, on, drawdown, scale, turnover, net, nav): steps with the level that the NAV so far calls for.

    The NAV starts at 1 and takes each date's net return, whose scale depends
    on the NAV's fall from its peak over the last ``rows`` + 1 values; one fold
    over a book's dates, in the JVM.
    """
    step = F.struct(F.col(k).alias("k"), F.col(on).alias("on"), "gross_ret", "scales", "turnovers")
    series = steps.groupBy(*by).agg(F.sort_array(F.collect_list(step)).alias("_steps"))
    day = steps.schema[on].dataType.simpleString()
    start = F.struct(F.array(F.lit(1.0)).alias("navs"), F.lit(0).alias("level"), F.array().cast(f"array<struct<on: {day}, drawdown: double, scale: double, turnover: double, net: double, nav: double>>").alias("out"))

    def fall(a: Column) -> Column:
        seen = F.slice(a["navs"], F.greatest(F.size(a["navs"]) - rows, F.lit(1)), F.lit(rows + 1))
        return F.element_at(a["navs"], -1) / F.array_max(seen) - 1

    def add(a: Column, x: Column) -> Column:
        down = fall(a)
        level = F.when(down <= hard, 2).when(down <= soft, 1).otherwise(0)
        scale, turned = F.get(x["scales"], level), F.get(F.get(x["turnovers"], level), a["level"])
        net = scale * x["gross_ret"] - turned * (2 * basis_points / 1e4)
        nav = F.element_at(a["navs"], -1) * (1 + net)
        row = F.struct(x["on"].alias("on"), down.alias("drawdown"), scale.alias("scale"), turned.alias("turnover"), net.alias("net"), nav.alias("nav"))
        return F.struct(F.concat(a["navs"], F.array(nav)).alias("navs"), level.alias("level"), F.concat(a["out"], F.array(row)).alias("out"))

    done = series.select(*by, F.explode(F.aggregate("_steps", start, add, lambda a: a["out"])).alias("r")).select(*by, "r.*")
    return done.withColumnRenamed("on", on)
