"""A two-state model of an index's changes, fitted by expectation-maximisation for many series and dates at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least variance of a state; fits that a task advances together.
_FLOOR, _TOGETHER = 1e-8, 256


def _densities(x: np.ndarray, mean: np.ndarray, var: np.ndarray) -> np.ndarray:
    """Gaussian densities of (fits, steps) values in both states: (fits, steps, 2)."""
    z = x[:, :, None] - mean[:, None, :]
    return np.exp(-0.5 * z * z / var[:, None, :]) / np.sqrt(2 * np.pi * var[:, None, :])


def forward(dens: np.ndarray, live: np.ndarray, start: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Filtered state probabilities of every step, and each step's likelihood given those before; steps that aren't ``live`` change nothing."""
    fits, steps, _ = dens.shape
    alpha, scale = np.empty((fits, steps, 2)), np.ones((fits, steps))
    last = start
    for t in range(steps):
        prior = last if t == 0 else np.einsum("fi,fij->fj", last, move)
        joint = prior * dens[:, t]
        total = joint.sum(axis=1)
        ok = live[:, t] & (total > 0)
        scale[ok, t] = total[ok]
        last = np.where(ok[:, None], joint / np.where(total > 0, total, 1)[:, None], last)
        alpha[:, t] = last
    return alpha, scale


def fit(x: np.ndarray, live: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, move, mean, variance, log likelihoods by round) of two Gaussian states for each row of ``x``.

    Starts from the lower and upper half of a series' absolute distances from its
    median: calm and restless changes. ``live`` marks a row's values; they are at its front.
    """
    fits, steps = x.shape
    n = np.maximum(live.sum(axis=1), 1)
    far = np.where(live, np.abs(x - np.array([np.median(r[m]) if m.any() else 0.0 for r, m in zip(x, live)])[:, None]), np.nan)
    middle = np.array([np.nanmedian(r) if m.any() else 0.0 for r, m in zip(far, live)])
    calm = np.stack([live & (far <= middle[:, None]), live & (far > middle[:, None])], axis=2).astype(float)
    weight = np.maximum(calm.sum(axis=1), 1e-12)
    mean = (calm * x[:, :, None]).sum(axis=1) / weight
    var = np.maximum((calm * (x[:, :, None] - mean[:, None, :]) ** 2).sum(axis=1) / weight, _FLOOR)
    start, move = np.full((fits, 2), 0.5), np.tile(np.array([[0.9, 0.1], [0.1, 0.9]]), (fits, 1, 1))
    found = []
    for _ in range(rounds):
        dens = _densities(x, mean, var)
        alpha, scale = forward(dens, live, start, move)
        found.append(np.where(live, np.log(np.maximum(scale, 1e-300)), 0).sum(axis=1))
        beta = np.ones((fits, 2))
        gamma, pairs = np.zeros((fits, steps, 2)), np.zeros((fits, 2, 2))
        for t in reversed(range(steps)):
            g = alpha[:, t] * beta
            gamma[:, t] = np.where(live[:, t, None], g / np.maximum(g.sum(axis=1, keepdims=True), 1e-300), 0)
            if t:
                later = (dens[:, t] * beta) / scale[:, t, None]
                both = alpha[:, t - 1, :, None] * move * later[:, None, :]
                pairs += np.where(live[:, t, None, None], both, 0)
                beta = np.where(live[:, t, None], np.einsum("fij,fj->fi", move, later), beta)
        total = np.maximum(gamma.sum(axis=1), 1e-12)
        mean = (gamma * x[:, :, None]).sum(axis=1) / total
        var = np.maximum((gamma * (x[:, :, None] - mean[:, None, :]) ** 2).sum(axis=1) / total, _FLOOR)
        start, move = gamma[:, 0], pairs / np.maximum(pairs.sum(axis=2, keepdims=True), 1e-12)
    return start, move, mean, var, np.array(found).T if rounds else np.zeros((len(n), 0))


def two_state_regimes(series: DataFrame, value: str, by: Sequence[str], on: str, dates: DataFrame, least: int = 50, rounds: int = 50, high: float = 0.7, low: float = 0.3) -> DataFrame:
    """(by, as_of, n, probability, regime) for every series and date of ``dates`` (one column).

    For each date a model of two Gaussian states is fitted to the changes of
    the logarithm up to it, and the probability of the state with the larger
    absolute mean change is filtered through the last one: nothing behind the date
    is used, neither for the parameters nor for the state. HIGH is above
    ``high``, LOW below ``low``; with fewer than ``least`` changes it is NORMAL and 0.5. Nulls and
    values that aren't positive are left out. A series (a row a day of an index) is one array;
    its dates are dealt out over tasks, and a task advances many fits together.
    """
    good = series.filter(F.col(value) > 0).select(*by, on, F.log(F.col(value).cast("double")).alias("_v"))
    arrays = good.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(on).alias("d"), "_v"))).alias("_s"))
    asked = arrays.crossJoin(F.broadcast(dates.distinct().toDF("as_of")))  # dates of a calendar, a row each
    upto = F.filter("_s", lambda x: x["d"] <= F.col("as_of"))
    rows = asked.select(*by, "as_of", F.transform(upto, lambda x: x["_v"]).alias("_x"))
    rows = rows.repartition(*by, "as_of")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), _TOGETHER):
                part = batch.iloc[a : a + _TOGETHER]
                changes = [np.diff(np.asarray(v, float)) for v in part["_x"]]
                n = np.array([len(c) for c in changes])
                prob = np.full(len(n), 0.5)
                long = np.flatnonzero(n >= least)
                if len(long):
                    live = np.arange(n[long].max())[None, :] < n[long, None]
                    x = np.zeros(live.shape)
                    x[live] = np.concatenate([changes[i] for i in long])
                    start, move, mean, var, _ = fit(x, live, rounds)
                    alpha, _ = forward(_densities(x, mean, var), live, start, move)
                    prob[long] = alpha[np.arange(len(long)), -1, np.argmax(np.abs(mean), axis=1)]
                name = np.where(prob > high, "HIGH", np.where(prob < low, "LOW", "NORMAL"))
                yield part[[*by, "as_of"]].assign(n=n, probability=prob, regime=name)

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInPandas(run, ", ".join([*(f"{c} {kinds[c]}" for c in (*by, "as_of")), "n long, probability double, regime string"]))
