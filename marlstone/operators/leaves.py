"""Numerical routines of legs and series.

A leg is a sector of a universe and may hold any number of names over one
calendar. What is quadratic in names is never held: covariances are a diagonal
plus a few factors, from sums of dates x dates that blocks of names add up to, and pairs of names
are met block by block. A group's own frame has one row of returns a name, or a monthly series.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.session import checkpointed


def shrinkage(x: np.ndarray) -> float:
    """The optimal intensity of shrinking the sample covariance (divisor T) towards a multiple of the identity."""
    x = x - x.mean(axis=0)
    t, n = x.shape
    s = x.T @ x / t
    mu = np.trace(s) / n
    d2 = ((s - mu * np.eye(n)) ** 2).sum() / n
    b2 = min(d2, sum(((np.outer(row, row) - s) ** 2).sum() for row in x) / (t * t * n))
    return 0.0 if d2 == 0 else b2 / d2


def shrunk_covariance(x: np.ndarray) -> np.ndarray:
    """Sample covariance (divisor T) shrunk by ``shrinkage``."""
    share, s = shrinkage(x), np.atleast_2d(np.cov(x, rowvar=False, ddof=0))
    return share * np.trace(s) / len(s) * np.eye(len(s)) + (1 - share) * s


def noise_density(x: np.ndarray, variance: float, q: float) -> np.ndarray:
    """Density of the eigenvalues that pure noise has, where ``q`` is observations per column."""
    low, high = (variance * (1 + s * q**-0.5) ** 2 for s in (-1, 1))
    return q / (2 * np.pi * variance * x) * np.sqrt(np.maximum((high - x) * (x - low), 0))


def noise_variance(eigenvalues: np.ndarray, q: float, bins: int = 50, points: int = 200, rounds: int = 4) -> float:
    """The variance whose noise density is nearest to the histogram of the eigenvalues inside its support.

    Densities are compared in units of the variance, since a wider support has
    lower ones everywhere and would always seem nearer. The squared distance
    jumps as eigenvalues come into the support, so it is searched on a grid of ``points``
    variances, and ``rounds`` times more around the best; 1 (all of a correlation matrix is
    noise) where no support holds five eigenvalues. Eigenvalues are rounded to nine places: the jumps
    would turn the order of sums into other variances.
    """
    eigenvalues = np.round(eigenvalues, 9)

    def distance(variance: float) -> float:
        low, high = (variance * (1 + s * q**-0.5) ** 2 for s in (-1, 1))
        inside = eigenvalues[(eigenvalues >= low) & (eigenvalues <= high)]
        if len(inside) < 5:
            return np.inf
        found, edges = np.histogram(inside, bins=bins, range=(low, high), density=True)
        middle = np.maximum((edges[1:] + edges[:-1]) / 2, 1e-12)
        return float(np.mean((variance * (found - noise_density(middle, variance, q))) ** 2))

    low, high = 1e-3, max(1.0, float(eigenvalues.max()))
    best, least = 1.0, np.inf
    for _ in range(rounds + 1):
        grid = np.linspace(low, high, points)
        far = np.array([distance(v) for v in grid])
        at = int(np.argmin(far))
        if far[at] < least:
            best, least = float(grid[at]), far[at]
        step = grid[1] - grid[0]
        low, high = max(1e-3, best - step), best + step
    return best


def denoised_covariance(x: np.ndarray) -> tuple[np.ndarray, float, int]:
    """Covariance without the noise of its correlations' small eigenvalues, then shrunk; with the noise edge and the eigenvalues below it.

    Correlation eigenvalues under the upper edge of the fitted noise density
    are replaced by their mean, which keeps the trace; the diagonal is made 1
    again and scaled by the deviations. What is left is shrunk towards a
    multiple of the identity by the intensity of ``shrunk_covariance``'s estimate.
    """
    t, n = x.shape
    sample = np.atleast_2d(np.cov(x, rowvar=False))
    sd = np.sqrt(np.diag(sample))
    sd[sd == 0] = 1e-10
    values, vectors = np.linalg.eigh(np.clip(sample / np.outer(sd, sd), -1, 1))
    q = t / n
    edge = noise_variance(values, q) * (1 + q**-0.5) ** 2
    noise = values < edge
    if noise.any():
        values = np.where(noise, values[noise].mean(), values)
    clean = (vectors * values) @ vectors.T
    scale = np.sqrt(np.maximum(np.diag(clean), 1e-12))
    clean = clean / np.outer(scale, scale) * np.outer(sd, sd)
    share = shrinkage(x)
    out = (1 - share) * clean + share * np.trace(clean) / n * np.eye(n)
    return (out + out.T) / 2, float(edge), int(noise.sum())


def _onto_capped_simplex(v: np.ndarray, cap: float) -> np.ndarray:
    """The nearest weights in [0, cap] that add up to 1."""
    lo, hi = v.min() - 1, v.max()
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if np.clip(v - mid, 0, cap).sum() > 1 else (lo, mid)
    return np.clip(v - hi, 0, cap)


def minimum_variance(x: np.ndarray, cap: float = 1.0, before: np.ndarray | None = None, penalty: float = 0.0, rounds: int = 500, covariance=shrunk_covariance) -> np.ndarray:
    """Weights of least variance (plus a penalty on change), by projected gradient; equal where a cap is infeasible."""
    n = x.shape[1]
    if n * cap <= 1 or len(x) < 2:
        return np.full(n, 1 / n)
    cov = covariance(x)
    return _descended(n, lambda w: cov @ w, np.linalg.eigvalsh(cov)[-1], cap, before, penalty, rounds)


def _descended(n: int, times, top: float, cap: float, before: np.ndarray | None = None, penalty: float = 0.0, rounds: int = 500) -> np.ndarray:
    """Projected gradient from equal weights, by a covariance's product with weights (``times``) and its largest eigenvalue."""
    w = np.full(n, 1 / n)
    old = w if before is None else before
    step = 1 / (2 * (top + penalty) + 1e-18)
    for _ in range(rounds):
        w = _onto_capped_simplex(w - step * (2 * times(w) + 2 * penalty * (w - old)), cap)
    return w


def largest_eigenvalue(diagonal: np.ndarray, load: np.ndarray) -> float:
    """Of diag(diagonal) + load load', without the matrix.

    Above the diagonal's largest entry, v is an eigenvalue where the largest one
    of load' (v - diagonal)^-1 load is 1; that falls with v, so it is bisected.
    """
    low = float(diagonal.max())
    high = low + float((load * load).sum())
    if load.shape[1] == 0 or high == low:
        return low
    for _ in range(100):
        mid = (low + high) / 2
        if not low < mid < high:
            break
        inner = load.T @ (load / (mid - diagonal)[:, None])
        low, high = (mid, high) if np.linalg.eigvalsh(inner)[-1] > 1 else (low, mid)
    return high


def _normalised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of names: without their means, and scaled so that their products are correlations."""
    x = x - x.mean(axis=1, keepdims=True)
    free = max(x.shape[1] - 1, 1)
    return x, x / np.sqrt(np.maximum((x * x).sum(axis=1) / free, 1e-18) * free)[:, None]


def spanning_tree(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, distance) with i < j: the least tree over rows of ``_normalised`` by squared correlation distance.

    Distances are rounded to twelve places, below which products are noise;
    of equal ones the edge of the first names counts as nearer, so that there is one tree.
    """
    n = len(z)
    far = z @ z.T
    far *= -0.5
    far += 0.5
    np.round(np.clip(far, 0, 1, out=far), 12, out=far)
    near, source, out = far[0].copy(), np.zeros(n, int), np.zeros(n, bool)
    near[0], out[0] = np.inf, True
    edges = np.empty((n - 1, 2), int)
    length = np.empty(n - 1)
    for k in range(n - 1):
        v = int(near.argmin())
        least = near[v]
        same = np.flatnonzero(near == least)
        if len(same) > 1:
            a, b = np.minimum(source[same], same), np.maximum(source[same], same)
            v = int(same[np.lexsort((b, a))[0]])
        edges[k], length[k] = sorted((source[v], v)), least
        near[v], out[v] = np.inf, True
        closer = ~out & ((far[v] < near) | ((far[v] == near) & (v < source)))
        near[closer], source[closer] = far[v][closer], v
    return edges[:, 0], edges[:, 1], length


def leaf_order(n: int, i: np.ndarray, j: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """The order of single linkage's leaves from edges that hold the least spanning tree: of two merged clusters, that of the first name comes first."""
    order = np.lexsort((j, i, distance))
    parent, after, last = list(range(n)), [-1] * n, list(range(n))

    def root(v: int) -> int:
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    merged = 0
    for a, b in zip(i[order].tolist(), j[order].tolist()):
        a, b = root(a), root(b)
        if a == b:
            continue
        a, b = min(a, b), max(a, b)  # a cluster's root is its first name and the head of its list
        parent[b] = a
        after[last[a]], last[a] = b, last[b]
        merged += 1
        if merged == n - 1:
            break
    leaves, v = [], 0
    while v >= 0:
        leaves.append(v)
        v = after[v]
    return np.array(leaves)


def bisected(x: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Weights of names (rows, without their means) by inverse-variance bisection of an order; a half's risk is the variance of its own series."""
    free = max(x.shape[1] - 1, 1)
    inverse = 1 / np.maximum((x * x).sum(axis=1) / free, 1e-18)
    weights, todo = np.ones(len(x)), [order]
    while todo:
        part = todo.pop()
        if len(part) < 2:
            continue
        halves = part[: len(part) // 2], part[len(part) // 2 :]
        risk = []
        for half in halves:
            series = (inverse[half] / inverse[half].sum()) @ x[half]
            risk.append(series @ series / free)
        share = 1 - risk[0] / (risk[0] + risk[1]) if sum(risk) > 0 else 0.5
        weights[halves[0]] *= share
        weights[halves[1]] *= 1 - share
        todo += halves
    return weights


def risk_parity_tree(x: np.ndarray) -> np.ndarray:
    """Hierarchical risk parity: single linkage on correlation distance, leaf order, inverse-variance bisection."""
    x, z = _normalised(x.T)
    return bisected(x, leaf_order(len(x), *spanning_tree(z)))


# ---------------------------------------------------------------- legs of any number of names

#: Names of a block: two blocks' distances are one task's largest array (at most about 134 MB), the covariances of two smaller ones one table.
_BLOCK, _PAIRS = 2048, 512


def _beside(df: DataFrame, few: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` with the columns of ``few`` (rows a group), null keys included."""
    renamed = few.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return df.join(F.broadcast(renamed), same).drop(*[f"_k_{k}" for k in keys])


def _packed(returns: DataFrame, by: Sequence[str], symbol: str, on: str, ret: str, least: int) -> DataFrame:
    """(by, symbol, s, n, t): one row a name, with its returns by place in the group's calendar of ``t`` dates; ``n`` names have enough rows."""
    value = F.col(ret).cast("double")
    known = returns.filter(value.isNotNull() & ~F.isnan(value) & F.col(symbol).isNotNull() & F.col(on).isNotNull())
    known = checkpointed(known.groupBy(*by, symbol, on).agg(F.avg(value).alias("r")))
    days = known.select(*by, on).distinct()
    place = days.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(on)) - 1)
    names = known.groupBy(*by, symbol).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least)
    sizes = _beside(names.groupBy(*by).agg(F.count("*").cast("int").alias("n")), days.groupBy(*by).agg(F.count("*").cast("int").alias("t")), by)
    rows = _beside(known, place, [*by, on]).groupBy(*by, symbol).agg(F.collect_list(F.struct("place", "r")).alias("s")).filter(F.size("s") >= least)
    return checkpointed(_beside(rows, sizes, by))


def _blocked(df: DataFrame, symbol: str, size: int) -> DataFrame:
    """Names dealt into blocks of about ``size``."""
    blocks = F.ceil(F.col("n") / size).cast("int")
    return df.withColumn("_blocks", blocks).withColumn("_block", F.pmod(F.xxhash64(symbol), F.col("_blocks")).cast("int"))


def _met(df: DataFrame, symbol: str, size: int, own: bool) -> DataFrame:
    """Every row once for each pair of blocks (lo <= hi) that has its own; pairs of a block with itself if ``own`` or where it is the only one."""
    other = F.sequence(F.lit(0), F.col("_blocks") - 1)
    kept = other if own else F.filter(other, lambda b: (b != F.col("_block")) | (F.col("_blocks") == 1))
    rows = _blocked(df, symbol, size).withColumn("_other", F.explode(kept))
    return rows.withColumns({"lo": F.least("_block", "_other"), "hi": F.greatest("_block", "_other")}).drop("_blocks", "_other")


def _matrix(table: pa.Table) -> np.ndarray:
    """Names x dates, gaps as 0."""
    lists = table["s"].combine_chunks()
    flat, lengths = lists.flatten(), np.diff(np.asarray(lists.offsets))
    x = np.zeros((len(table), table["t"][0].as_py()))
    x[np.repeat(np.arange(len(table)), lengths), np.asarray(flat.field("place"))] = np.asarray(flat.field("r"))
    return x


def _same(table: pa.Table, by: Sequence[str], rows: int) -> dict[str, pa.Array]:
    """The group's keys, ``rows`` times."""
    return {b: pa.repeat(table[b][0], rows) for b in by}


def _fields(df: DataFrame, columns: Sequence[str], *more: str) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), *more])


def _moments(packed: DataFrame, by: Sequence[str], symbol: str) -> DataFrame:
    """(by, total, shrink, scale, top, edge, noise, floor, basis): what all names of a group say together.

    Blocks of names add up the products of dates with dates, of returns and of
    normalised ones. These have the eigenvalues of the covariance and of the
    correlations, and all sums that shrinkage needs; ``basis`` takes a name's normalised
    returns to its loads on the eigenvectors over the noise edge.
    """

    def part(table: pa.Table) -> pa.Table:
        x, z = _normalised(_matrix(table))
        sums = [pa.array([(m.T @ m).tobytes()], pa.binary()) for m in (x, z)]
        return pa.table({**_same(table, by, 1), "n": table["n"].slice(0, 1), "t": table["t"].slice(0, 1), "g": sums[0], "k": sums[1]})

    parts = _blocked(packed, symbol, _BLOCK).groupBy(*by, "_block").applyInArrow(part, _fields(packed, [*by, "n", "t"], "g binary", "k binary"))

    def whole(table: pa.Table) -> pa.Table:
        n, t = table["n"][0].as_py(), table["t"][0].as_py()
        g, k = (sum(np.frombuffer(b.as_buffer()).reshape(t, t) for b in table[c]) for c in ("g", "k"))
        free = max(t - 1, 1)
        found = moments(g, k, n)
        basis = pa.array([found.pop("basis").tobytes()], pa.binary())
        return pa.table({**_same(table, by, 1), **{c: pa.array([v], pa.int32() if c == "noise" else pa.float64()) for c, v in found.items()}, "basis": basis, "free": pa.array([free], pa.int32())})

    return parts.groupBy(*by).applyInArrow(whole, _fields(parts, by, "share double, mean double, top double, edge double, noise int, floor double, basis binary, free int"))


def moments(g: np.ndarray, k: np.ndarray, n: int) -> dict:
    """Shrinkage, noise edge and factors of ``n`` names from dates x dates: ``g`` sums products of centred returns, ``k`` of normalised ones."""
    t = len(g)
    mean, square = np.trace(g) / t / n, (g * g).sum() / t**2  # of the covariance with divisor T
    d2 = (square - n * mean**2) / n
    b2 = min(d2, ((np.diag(g) ** 2).sum() - t * square) / (t * t * n))
    share = 0.0 if d2 == 0 else float(b2 / d2)
    top = share * mean + (1 - share) * np.linalg.eigvalsh(g)[-1] / t
    values, vectors = np.linalg.eigh(k)
    values, vectors = values[-min(n, t) :], vectors[:, -min(n, t) :]
    none = n - len(values)  # eigenvalues that are 0 for want of dates
    if n == 1:
        edge, noise, floor, signal = np.nan, 0, 0.0, np.ones(1, bool)
    else:
        edge = float(noise_variance(values, t / n) * (1 + (t / n) ** -0.5) ** 2)
        signal = values >= edge
        noise = int((~signal).sum()) + none
        floor = float(values[~signal].sum() / noise) if noise else 0.0
    lengths = np.sqrt(np.maximum(values[signal] - floor, 0) / np.maximum(values[signal], 1e-300))
    return {"share": share, "mean": float(mean), "top": float(top), "edge": edge, "noise": noise, "floor": floor, "basis": vectors[:, signal] * lengths}


def _loads(packed: DataFrame, by: Sequence[str], symbol: str, few: DataFrame) -> DataFrame:
    """(by, symbol, n, own, load, edge, noise): a denoised and shrunk covariance as ``own`` on the diagonal plus products of loads."""

    def run(table: pa.Table) -> pa.Table:
        x, z = _normalised(_matrix(table))
        get = {c: table[c][0].as_py() for c in ("share", "mean", "floor", "free", "t", "n")}
        load = z @ np.frombuffer(table["basis"][0].as_buffer()).reshape(get["t"], -1)
        share = get["share"] if get["n"] > 1 else 0.0
        sd = np.sqrt((x * x).sum(axis=1) / get["free"])
        scale = sd / np.sqrt(np.maximum(get["floor"] + (load * load).sum(axis=1), 1e-12))
        own = (1 - share) * get["floor"] * scale**2 + share * get["mean"] * get["t"] / get["free"]
        load = load * (np.sqrt(1 - share) * scale)[:, None]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(load) + 1) * load.shape[1], pa.int32()), pa.array(load.ravel()))
        return pa.table({**{c: table[c] for c in (*by, symbol, "n", "edge", "noise")}, "own": pa.array(own), "load": lists})

    rows = _beside(_blocked(packed, symbol, _BLOCK), few, by)
    return rows.groupBy(*by, "_block").applyInArrow(run, _fields(rows, [*by, symbol, "n", "edge", "noise"], "own double", "load array<double>"))


def _rows_of(table: pa.Table, column: str) -> np.ndarray:
    return np.asarray(table[column].combine_chunks().flatten()).reshape(len(table), -1)


def leg_weights(returns: DataFrame, by: Sequence[str], symbol: str, on: str, ret: str, method: str = "minimum_variance", cap: float = 0.25, least: int = 20) -> DataFrame:
    """(by, symbol, weight): each group's weights from its returns; names with too few rows are left out, gaps count as 0.

    ``method`` is ``minimum_variance`` (on the shrunk covariance), ``denoised`` (on the denoised one) or ``risk_parity``.
    The last step of a group is one task that holds a row of returns (or of a few loads) a name; all that is
    quadratic in names is met in blocks before it.
    """
    packed = _packed(returns, by, symbol, on, ret, least)
    schema = _fields(packed, [*by, symbol], "weight double")

    def weighed(table: pa.Table, w: np.ndarray) -> pa.Table:
        return pa.table({**{c: table[c] for c in (*by, symbol)}, "weight": pa.array(w, pa.float64())})

    if method == "risk_parity":

        def tree(table: pa.Table) -> pa.Table:
            table = table.sort_by(symbol)
            i, j, distance = spanning_tree(_normalised(_matrix(table))[1])
            names = table[symbol]
            return pa.table({**_same(table, by, len(i)), "a": names.take(pa.array(i)), "b": names.take(pa.array(j)), "distance": pa.array(distance)})

        kind = packed.schema[symbol].dataType.simpleString()
        # an edge of the least tree of all names is one of the least tree of any names that have its two
        edges = _met(packed, symbol, _BLOCK, own=False).groupBy(*by, "lo", "hi").applyInArrow(tree, _fields(packed, by, f"a {kind}, b {kind}, distance double"))

        def parity(table: pa.Table, edges: pa.Table) -> pa.Table:
            table = table.sort_by(symbol)
            names = table[symbol].combine_chunks()
            i, j = (np.asarray(pc.index_in(edges[c].combine_chunks(), names)) for c in ("a", "b"))
            order = leaf_order(len(table), i, j, np.asarray(edges["distance"]))
            return weighed(table, bisected(_normalised(_matrix(table))[0], order))

        return packed.groupBy(*by).cogroup(edges.groupBy(*by)).applyInArrow(parity, schema)

    few = _moments(packed, by, symbol)
    if method == "denoised":

        def denoised(table: pa.Table) -> pa.Table:
            n, own = len(table), np.asarray(table["own"])
            if n * cap <= 1:
                return weighed(table, np.full(n, 1 / n))
            load = _rows_of(table, "load")
            return weighed(table, _descended(n, lambda w: own * w + load @ (w @ load), largest_eigenvalue(own, load), cap))

        return _loads(packed, by, symbol, few).groupBy(*by).applyInArrow(denoised, schema)

    def shrunk(table: pa.Table) -> pa.Table:
        n, t = len(table), table["t"][0].as_py()
        if n * cap <= 1 or t < 2:
            return weighed(table, np.full(n, 1 / n))
        x, (share, mean, top) = _normalised(_matrix(table))[0], (table[c][0].as_py() for c in ("share", "mean", "top"))
        return weighed(table, _descended(n, lambda w: share * mean * w + (1 - share) / t * (x @ (w @ x)), top, cap))

    return _beside(packed, few.drop("basis"), by).groupBy(*by).applyInArrow(shrunk, schema)


def leg_covariances(returns: DataFrame, by: Sequence[str], symbol: str, on: str, ret: str, least: int = 20) -> DataFrame:
    """(by, a, b, covariance, edge, noise): the denoised covariance of each group's names (a <= b), the noise edge and how many eigenvalues lie below it.

    A group's only name has its variance and no edge; names with too few rows are left out.
    The pairs are multiplied out block by block from each name's few loads.
    """
    packed = _packed(returns, by, symbol, on, ret, least)
    loads = _loads(packed, by, symbol, _moments(packed, by, symbol))
    kind = packed.schema[symbol].dataType.simpleString()
    rows = _met(loads, symbol, _PAIRS, own=True)

    def pairs(table: pa.Table) -> pa.Table:
        table = table.sort_by(symbol)
        block, load, names = np.asarray(table["_block"]), _rows_of(table, "load"), table[symbol]
        first, second = (np.flatnonzero(block == table[c][0].as_py()) for c in ("lo", "hi"))
        found = load[first] @ load[second].T
        i, j = np.repeat(first, len(second)), np.tile(second, len(first))
        found = found.ravel()
        if table["lo"][0].as_py() == table["hi"][0].as_py():
            found, i, j = found[i <= j], i[i <= j], j[i <= j]
            found[i == j] += np.asarray(table["own"])[i[i == j]]
        low, high = np.minimum(i, j), np.maximum(i, j)
        edge, noise = (pa.repeat(table[c][0], len(i)) for c in ("edge", "noise"))
        return pa.table({**_same(table, by, len(i)), "a": names.take(pa.array(low)), "b": names.take(pa.array(high)), "covariance": pa.array(found), "edge": edge, "noise": noise})

    return rows.groupBy(*by, "lo", "hi").applyInArrow(pairs, _fields(packed, by, f"a {kind}, b {kind}, covariance double, edge double, noise int"))


def scaled_navs(series: DataFrame, ret: str, by: Sequence[str], on: str, rows: int = 12) -> DataFrame:
    """(by, on, scale, nav): returns scaled by the drawdown of the NAV that the scaled returns themselves have made.

    The scale of a date depends on all NAVs before it, so each series is one
    sequential pass: 1 near the peak of the last ``rows`` dates, 0.75 from 5 %
    and 0.5 from 10 % below it.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(on)
        navs, scales = [1.0], []
        for r in group[ret].fillna(0.0):
            fall = navs[-1] / max(navs[-(rows + 1) :]) - 1
            scales.append(0.5 if fall <= -0.10 else 0.75 if fall <= -0.05 else 1.0)
            navs.append(navs[-1] * (1 + scales[-1] * r))
        return group[[*by, on]].assign(scale=scales, nav=navs[1:])

    kinds = {f.name: f.dataType.simpleString() for f in series.schema}
    return series.groupBy(*by).applyInPandas(run, ", ".join([*(f"{c} {kinds[c]}" for c in (*by, on)), "scale double", "nav double"]))


#: Weights of momentum and value of each arm; the other factors have none (fixed values).
ARMS = ((0.50, 0.50), (0.60, 0.40), (0.70, 0.30), (0.40, 0.60), (0.30, 0.70), (0.80, 0.20), (0.20, 0.80), (0.55, 0.45))


def bandit_replay(series: DataFrame, context: str, rewards: str, by: Sequence[str], on: str, seed: str, warm: int = 6, v: float = 0.25, prior: float = 1.0) -> DataFrame:
    """(by, on, arm, reward, best, mean, means, stds): linear Thompson sampling replayed over each series.

    ``context`` is an array of numbers, ``rewards`` one of what every arm would
    have earned on that date. Arm 0 is played for the first ``warm`` dates,
    then the arm whose sampled weights promise most for the context; samples
    are N(mean, v^2 A^-1) with A = I / prior + sum x x' and mean = A^-1 sum x r
    over the dates an arm was played. Only the played arm's reward is learned.
    ``best`` is the highest reward of the date; means and stds are those of all arms'
    weights before the date's update. Nulls count as 0. Each series has its ``seed``
    (a column that is constant in it) and is one sequential pass over a row a date, so many series or seeds are replayed side by side.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(on)
        x = np.nan_to_num(np.array(group[context].tolist(), float))
        paid = np.nan_to_num(np.array(group[rewards].tolist(), float))
        rng, d, arms = np.random.default_rng(int(group[seed].iloc[0])), x.shape[1], paid.shape[1]
        a, r, rows = np.stack([np.eye(d) / prior] * arms), np.zeros((arms, d)), []
        for t in range(len(x)):
            inverse = np.linalg.inv(a)
            mean = np.einsum("kij,kj->ki", inverse, r)
            arm = 0
            if t >= warm:
                noise = np.einsum("kij,kj->ki", np.linalg.cholesky(inverse), rng.standard_normal((arms, d)))
                arm = int(np.argmax((mean + v * noise) @ x[t]))
            stds = np.sqrt(np.abs(np.einsum("kii->ki", inverse)))
            rows.append((arm, paid[t, arm], paid[t].max(), float(mean[arm] @ x[t]), mean.tolist(), stds.tolist()))
            a[arm] += np.outer(x[t], x[t])
            r[arm] += x[t] * paid[t, arm]
        found = pd.DataFrame(rows, columns=["arm", "reward", "best", "mean", "means", "stds"])
        return pd.concat([group[[*by, on]].reset_index(drop=True), found], axis=1)

    kinds = {f.name: f.dataType.simpleString() for f in series.schema}
    fields = "arm int, reward double, best double, mean double, means array<array<double>>, stds array<array<double>>"
    return series.groupBy(*by).applyInPandas(run, ", ".join([*(f"{c} {kinds[c]}" for c in (*by, on)), fields]))
