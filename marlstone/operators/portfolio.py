"""Books of weights: construction, costs, risk scaling and ledgers."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def score_weights(legs: DataFrame, score: str, side: str, by: Sequence[str], gross: float = 1.0, name: str = "weight") -> DataFrame:
    """Weights in proportion to the score's distance beyond the leg's median; equal where none is beyond.

    ``side`` is 1 for long and -1 for short rows (others are left out); each
    leg adds up to half of ``gross``, shorts with negative weights.
    """
    w = Window.partitionBy(*by, side)
    ahead = (F.col(score) - F.median(score).over(w)) * F.col(side)
    lifted = legs.filter(F.col(side).isin(1, -1)).withColumn("_up", F.greatest(ahead, F.lit(0.0)))
    total = F.sum("_up").over(w)
    share = F.when(total > 0, F.col("_up") / total).otherwise(1 / F.count("*").over(w))
    return lifted.withColumn(name, share * (gross / 2) * F.col(side)).drop("_up")


def capped(weights: DataFrame, weight: str, by: Sequence[str], cap: float, rounds: int = 50, tolerance: float = 1e-9) -> DataFrame:
    """Weights cut to ``cap``, the excess spread over the others by their room; what finds no room stays cash.

    A leg is a few hundred names, each group is one pandas frame.
    """

    def fill(w: np.ndarray) -> np.ndarray:
        w = w.copy()
        for _ in range(rounds):
            over = np.maximum(w - cap, 0).sum()
            w = np.minimum(w, cap)
            room = cap - w
            if over <= tolerance or room.sum() <= tolerance:
                break
            w += room * min(1.0, over / room.sum())
        return w

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return group.assign(**{weight: fill(group[weight].to_numpy(float))})

    return weights.groupBy(*by).applyInPandas(run, weights.schema)


def book_changes(books: DataFrame, weight: str, by: Sequence[str], symbol: str, on: str) -> DataFrame:
    """(on, symbol, new, old): every position beside the one of the date before, 0 where there is none.

    ``on`` numbers the dates without gaps. Each position is the new one of its
    date and the old one of the next, so the books are read once and summed
    instead of joined with themselves; the date after the last book appears
    with everything closed.
    """
    w = F.col(weight).cast("double")
    both = F.array(F.struct(F.col(on).alias("at"), w.alias("new"), F.lit(0.0).alias("old")), F.struct((F.col(on) + 1).alias("at"), F.lit(0.0).alias("new"), w.alias("old")))
    rows = books.select(*by, symbol, F.explode(both).alias("r"))
    return rows.groupBy(*by, F.col("r.at").alias(on), symbol).agg(F.sum("r.new").alias("new"), F.sum("r.old").alias("old"))


def turnover(changes: DataFrame, by: Sequence[str]) -> DataFrame:
    """Half the absolute change of all weights."""
    return changes.groupBy(*by).agg((F.sum(F.abs(F.col("new") - F.col("old"))) / 2).alias("turnover"))


def cost_drag(turnover: Column, basis_points: float) -> Column:
    """Both sides of a one-way turnover pay ``basis_points``."""
    return turnover * 2 * basis_points / 1e4


def trade_ledger(changes: DataFrame, keys: Sequence[str], nav: float = 1e6) -> DataFrame:
    """One row per changed position of ``book_changes``: action, side, notional and impact in basis points."""
    both = changes.withColumn("change", F.col("new") - F.col("old")).filter(F.abs("change") > 1e-12)
    action = F.when(F.col("old") == 0, "open").when(F.col("new") == 0, "close").otherwise("adjust")
    return both.select(
        *keys,
        action.alias("action"),
        F.when(F.col("change") > 0, "buy").otherwise("sell").alias("side"),
        "change",
        (F.abs("change") * nav).alias("notional"),
        (5 * F.sqrt(F.abs("change"))).alias("impact_bp"),
    )


def exposures(books: DataFrame, weight: str, by: Sequence[str]) -> DataFrame:
    w = F.col(weight)
    return books.groupBy(*by).agg(
        F.sum(F.abs(w)).alias("gross"),
        F.sum(w).alias("net"),
        F.sum(w * w).alias("hhi"),
        F.count_if(w > 0).alias("n_long"),
        F.count_if(w < 0).alias("n_short"),
    )


def portfolio_returns(books: DataFrame, returns: DataFrame, weight: str, ret: str, on: Sequence[str], symbol: str, by: Sequence[str]) -> DataFrame:
    """Sum of weight * return, a missing return as 0."""
    joined = books.join(returns.select(*on, symbol, ret), [*on, symbol], "left")
    return joined.groupBy(*by).agg(F.sum(F.col(weight) * F.coalesce(F.col(ret), F.lit(0.0))).alias("port_ret"))


def tail_risk(series: DataFrame, ret: str, by: Sequence[str], confidence: float = 0.99, least: int = 30, var_default: float = 0.02, es_default: float = 0.025) -> DataFrame:
    """Historical value at risk and expected shortfall, with defaults under ``least`` rows."""
    q = series.groupBy(*by).agg(F.percentile(ret, F.lit(1 - confidence)).alias("_q"), F.count(ret).alias("n"))
    tail = series.join(q, list(by)).filter(F.col(ret) <= F.col("_q")).groupBy(*by).agg(F.avg(ret).alias("_es"))
    out = q.join(tail, list(by), "left")
    enough = F.col("n") >= least
    return out.select(*by, "n", F.when(enough, -F.col("_q")).otherwise(var_default).alias("var"), F.when(enough, -F.col("_es")).otherwise(es_default).alias("es"))


def vol_scalar(deviation: Column, rows: Column, target: float = 0.10, periods: int = 252, low: float = 0.3, high: float = 1.5, least: int = 10) -> Column:
    """target / annualised deviation within limits; 1 where there are too few rows."""
    scaled = F.try_divide(F.lit(target), deviation * periods**0.5)
    return F.when((rows < least) | scaled.isNull(), F.lit(1.0)).otherwise(F.greatest(F.least(scaled, F.lit(high)), F.lit(low)))
