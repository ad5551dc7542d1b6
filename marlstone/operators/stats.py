"""Statistics of return series, resampling and attribution."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.timeseries import cumulative_growth


def performance(series: DataFrame, ret: str, by: Sequence[str], periods: int = 12, rf: float = 0.0) -> DataFrame:
    """Annualised and distributional metrics of each series, in one aggregation."""
    r, n = F.col(ret), F.count(ret)
    excess = r - rf / periods
    sd, down = F.stddev_samp(excess), F.stddev_samp(F.when(excess < 0, excess))
    return series.groupBy(*by).agg(
        n.alias("n"),
        (F.pow(F.product(1 + r), periods / n) - 1).alias("ann_return"),
        (F.stddev_samp(r) * periods**0.5).alias("ann_vol"),
        F.when(sd > 1e-12, F.avg(excess) / sd * periods**0.5).otherwise(0.0).alias("sharpe"),
        F.when(F.count_if(excess < 0) >= 2, F.try_divide(F.avg(excess) * periods**0.5, down)).alias("sortino"),
        F.skewness(r).alias("skew"),
        F.kurtosis(r).alias("excess_kurtosis"),
        F.avg((r > 0).cast("double")).alias("hit_rate"),
        F.avg((r < 0).cast("double")).alias("pct_negative"),
        F.max(r).alias("best"),
        F.min(r).alias("worst"),
        (F.sqrt(F.avg(F.pow(F.least(r, F.lit(0.0)), 2))) * periods**0.5).alias("downside_dev"),
    )


def calmar(ann_return: Column, max_drawdown: Column) -> Column:
    """Annual return per deepest drawdown; infinite where there is none."""
    return F.when(max_drawdown < 0, ann_return / F.abs(max_drawdown)).otherwise(float("inf"))


def versus_benchmark(series: DataFrame, ret: str, benchmark: str, by: Sequence[str], periods: int = 12) -> DataFrame:
    """Information ratio, tracking error, mean active return and beta."""
    active = F.col(ret) - F.col(benchmark)
    sd = F.stddev_samp(active)
    return series.groupBy(*by).agg(
        (F.avg(active) * periods).alias("active_return"),
        (sd * periods**0.5).alias("tracking_error"),
        F.when(sd > 0, F.avg(active) * periods / (sd * periods**0.5)).otherwise(0.0).alias("information_ratio"),
        F.when(F.var_samp(benchmark) > 0, F.covar_samp(ret, benchmark) / F.var_samp(benchmark)).otherwise(0.0).alias("beta"),
    )


def block_start(path: Column, block: Column, n: Column, seed: int) -> Column:
    """A block's first row: a digest of path, block and seed, so that any engine draws the same and no two paths share a pattern."""
    digest = F.md5(F.concat_ws("-", path.cast("string"), block.cast("string"), F.lit(str(seed))).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") % n


def _resampled(series: DataFrame, ret: str, by: Sequence[str], on: str, block: int, paths: int, seed: int) -> DataFrame:
    """(by, path, step, ret): circular block resamples; a digest is taken for each block, whose rows are then counted out."""
    rows = series.withColumn("i", F.row_number().over(Window.partitionBy(*by).orderBy(on)) - 1)
    sizes = rows.groupBy(*by).agg(F.count("*").alias("n"))
    blocks = sizes.withColumn("path", F.explode(F.sequence(F.lit(0), F.lit(paths - 1)))).withColumn("b", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / block).cast("int"))))
    drawn = blocks.withColumn("start", block_start(F.col("path").cast("long"), F.col("b").cast("long"), F.col("n"), seed))
    inside = F.sequence(F.lit(0), F.least(F.lit(block), (F.col("n") - F.col("b") * block).cast("int")) - 1)
    picked = drawn.withColumn("j", F.explode(inside)).select(*by, "path", (F.col("b") * block + F.col("j")).cast("int").alias("step"), ((F.col("start") + F.col("j")) % F.col("n")).cast("int").alias("i"))
    return picked.join(rows.select(*by, "i", ret), [*by, "i"]).drop("i")


def bootstrap_sharpe(series: DataFrame, ret: str, by: Sequence[str], on: str, block: int = 6, paths: int = 1000, seed: int = 42, periods: int = 12) -> DataFrame:
    """Sharpe ratios of circular block resamples: mean and 95 % interval per series.

    A resample is rows of the series joined by index, so paths are spread over
    all tasks and only one number per path is gathered.
    """
    sd = F.stddev_samp(ret)
    sharpe = _resampled(series, ret, by, on, block, paths, seed).groupBy(*by, "path").agg(F.when(sd > 1e-12, F.avg(ret) / sd * periods**0.5).otherwise(0.0).alias("s"))
    return sharpe.groupBy(*by).agg(F.avg("s").alias("mean"), F.percentile("s", F.lit(0.025)).alias("low"), F.percentile("s", F.lit(0.975)).alias("high"), F.count("*").alias("paths"))


def monte_carlo_paths(series: DataFrame, ret: str, by: Sequence[str], on: str, block: int = 6, paths: int = 10_000, seed: int = 42) -> DataFrame:
    """NAV along every circular block path: (by, path, step, nav)."""
    picked = _resampled(series, ret, by, on, block, paths, seed)
    return picked.select(*by, "path", "step", cumulative_growth(F.col(ret), [*by, "path"], "step").alias("nav"))


def path_bands(paths: DataFrame, by: Sequence[str], points: Sequence[float] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """(by, step, paths, mean, p05, ...): percentiles of all paths' NAV at each step, exact, gathered by step."""
    cells = F.percentile("nav", F.lit(list(points)))
    out = paths.groupBy(*by, "step").agg(F.count("*").alias("paths"), F.avg("nav").alias("mean"), cells.alias("_q"))
    return out.select(*by, "step", "paths", "mean", *[F.col("_q")[i].alias(f"p{round(100 * p):02d}") for i, p in enumerate(points)])


def permutation_gap(series: DataFrame, ret: str, group: str, first: str, second: str, on: str, rounds: int = 1000, seed: int = 42, periods: int = 12) -> DataFrame:
    """Two-sided p value of the gap between two series' Sharpe ratios, by shuffling their pooled rows.

    A round sorts the pool by a digest of row and round; the first ones are
    dealt to the first series, as many as it has rows.
    """
    pool = series.filter(F.col(group).isin(first, second)).withColumn("_i", F.row_number().over(Window.partitionBy(group).orderBy(on)))
    dealt = pool.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds))))
    key = F.md5(F.concat_ws("-", F.col(group).cast("string"), F.col("_i").cast("string"), F.col("round").cast("string"), F.lit(str(seed))).cast("binary"))
    one = Window.partitionBy("round")
    own = F.count_if(F.col(group) == first).over(one)
    dealt = dealt.withColumn("side", F.when(F.col("round") == 0, F.col(group) == first).otherwise(F.row_number().over(one.orderBy(key)) <= own))
    ratio = lambda side: F.avg(F.when(side, F.col(ret))) / F.stddev_samp(F.when(side, F.col(ret))) * periods**0.5
    gaps = dealt.groupBy("round").agg(F.round(ratio(F.col("side")) - ratio(~F.col("side")), 9).alias("gap"))
    seen = gaps.agg(F.max(F.when(F.col("round") == 0, F.col("gap"))).alias("seen"))
    both = gaps.filter("round > 0").crossJoin(F.broadcast(seen))  # the right side is one row
    return both.groupBy(F.col("seen").alias("gap")).agg((F.count_if(F.abs("gap") >= F.abs("seen")) / F.count("*")).alias("p_value"), F.count("*").alias("rounds"))


def sign_flips(series: DataFrame, value: str, by: Sequence[str], on: str, rounds: int = 2000, seed: int = 42) -> DataFrame:
    """(by, mean, p_value): whether a mean differs from 0, by flipping the signs of rows at random.

    A row's sign in a round is the last bit of a digest of its number, the round
    and the seed. p counts the rounds whose mean is at least as far from 0, and the
    observed one, so it is never 0. Rounds are spread over tasks; a sum comes back for each.
    """
    rows = series.filter(F.col(value).isNotNull()).withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(on)))
    thrown = rows.withColumn("_round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    digest = F.md5(F.concat_ws("-", *[F.col(b).cast("string") for b in by], F.col("_i").cast("string"), F.col("_round").cast("string"), F.lit(str(seed))).cast("binary"))
    flip = F.conv(F.substring(digest, 32, 1), 16, 10).cast("int") % 2 == 1
    means = thrown.groupBy(*by, "_round").agg(F.avg(F.when(flip, -F.col(value)).otherwise(F.col(value))).alias("_m"))
    seen = rows.groupBy(*by).agg(F.avg(value).alias("mean"))
    far = F.round(F.abs("_m"), 12) >= F.round(F.abs("mean"), 12)
    return means.join(seen, list(by)).groupBy(*by, "mean").agg(((F.count_if(far) + 1) / (F.count("*") + 1)).alias("p_value"))


def cpcv_splits(n_dates: DataFrame, on: str, groups: int = 12, purge: int = 2, embargo: int = 1) -> DataFrame:
    """Combinatorial splits with two test groups: (split, g1, g2, date number, role).

    ``n_dates`` numbers dates 0, 1, ... in ``on``. Group g has the dates from
    floor(g n / groups) on. Train rows within ``purge`` of a test group on
    either side, and ``embargo`` more behind it, are left out.
    """
    pairs = [(k, a, b) for k, (a, b) in enumerate((a, b) for a in range(groups) for b in range(a + 1, groups))]
    splits = F.broadcast(n_dates.sparkSession.createDataFrame(pairs, "split int, g1 int, g2 int"))
    n, i = F.col("_n"), F.col(on)
    test, near = F.lit(False), F.lit(False)
    for g in ("g1", "g2"):
        lo, hi = F.floor(F.col(g) * n / groups), F.floor((F.col(g) + 1) * n / groups)
        test = test | ((i >= lo) & (i < hi))
        near = near | ((i >= lo - purge) & (i < lo)) | ((i >= hi) & (i < hi + purge + embargo))
    role = F.when(test, "test").when(near, "left_out").otherwise("train")
    total = F.broadcast(n_dates.agg((F.max(on) + 1).alias("_n")))
    return n_dates.select(on).crossJoin(total).crossJoin(splits).select("split", "g1", "g2", on, role.alias("role"))


def held_out_folds(series: DataFrame, by: Sequence[str], on: str, groups: int = 12) -> DataFrame:
    """Each row once for every split (of ``cpcv_splits``) that tests it, with the split's number; ``on`` numbers rows 0, 1, ... in each series."""
    pairs = [(a, b) for a in range(groups) for b in range(a + 1, groups)]
    splits = F.array(*[F.struct(F.lit(k).alias("split"), F.lit(a).alias("g1"), F.lit(b).alias("g2")) for k, (a, b) in enumerate(pairs)])
    n, i = F.col("_n"), F.col(on)
    inside = lambda g: (i >= F.floor(g * n / groups)) & (i < F.floor((g + 1) * n / groups))
    counted = series.withColumn("_n", F.count("*").over(Window.partitionBy(*by)))
    return counted.withColumn("_s", F.explode(F.filter(splits, lambda s: inside(s["g1"]) | inside(s["g2"])))).select(*series.columns, "_s.split")


def t_statistics(betas: DataFrame, columns: Sequence[str], least: int = 3) -> DataFrame:
    """Mean, t value and rows of each column."""
    long = betas.select(F.explode(F.array(*[F.struct(F.lit(c).alias("factor"), F.col(c).alias("b")) for c in columns])).alias("f")).select("f.*").filter("b is not null")
    n = F.count("*")
    return long.groupBy("factor").agg(F.avg("b").alias("mean"), F.when(n >= least, F.try_divide(F.avg("b"), F.stddev_samp("b") / F.sqrt(n))).alias("t_stat"), n.alias("n"))


def ic_summary(ic: DataFrame, value: str, by: Sequence[str], least: int = 3) -> DataFrame:
    n = F.count(value)
    return ic.groupBy(*by).agg(
        F.avg(value).alias("mean_ic"),
        F.when(n >= least, F.try_divide(F.avg(value), F.stddev_samp(value))).alias("ic_ir"),
        F.avg((F.col(value) > 0).cast("double")).alias("pct_positive"),
        n.alias("n"),
    )


def amihud(df: DataFrame, ret: str, volume: str, by: Sequence[str]) -> DataFrame:
    """Mean of |return| per dollar traded, and mean dollars; days without volume don't count."""
    v = F.nullif(F.col(volume), F.lit(0.0))
    return df.groupBy(*by).agg(F.avg(F.abs(ret) / v).alias("illiquidity"), F.avg(volume).alias("adv"))


def capacity_frame(book: DataFrame, liquidity: DataFrame, weight: str, on: Sequence[str]) -> DataFrame:
    """Positions whose illiquidity and dollar volume are known."""
    return book.join(liquidity, list(on)).filter(f"{weight} is not null and illiquidity is not null and adv is not null")


def capacity(frame: DataFrame, weight: str, illiquidity: str, by: Sequence[str], budget_bp: float = 15.0, aum: float = 1e6) -> DataFrame:
    """Per book: the largest fund that keeps every position's impact within the budget, positions, median illiquidity, and all impact at ``aum``.

    A position's impact is |weight| * fund * illiquidity, in basis points; positions under 1e-6 don't count.
    """
    need = F.abs(weight) * F.col(illiquidity) * 1e4
    there = F.abs(weight) > 1e-6
    return frame.groupBy(*by).agg(
        F.min(F.when(there & (F.col(illiquidity) > 0), F.try_divide(F.lit(budget_bp), need))).alias("max_aum"),
        F.count_if(there).alias("n_stocks"),
        F.median(illiquidity).alias("median_illiquidity"),
        F.sum(need * aum).alias("impact_bp"),
    )


def normal_cdf(x: Column, far: float = 7.0, terms: int = 160) -> Column:
    """The standard normal distribution function by its power series, to about 1e-12; 0 or 1 beyond ``far``."""
    # the square travels in the state: a column that only the lambda's body names would be resolved as an alias of the same select first
    start = F.struct(x.alias("s"), x.alias("t"), (x * x).alias("q"))

    def add(a: Column, k: Column) -> Column:
        t = a["t"] * a["q"] / (2 * k + 1)
        return F.struct((a["s"] + t).alias("s"), t.alias("t"), a["q"].alias("q"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), start, add, lambda a: a["s"])
    return F.when(x > far, 1.0).when(x < -far, 0.0).when(x.isNotNull(), 0.5 + series * F.exp(-x * x / 2) / (2 * math.pi) ** 0.5)


def probabilistic_sharpe(sharpe: Column, threshold: Column | float, n: Column, skew: Column, kurtosis: Column, floor: float = 1e-12, least: int = 10) -> Column:
    """Probability that the true ratio of a period exceeds the threshold; ``kurtosis`` is excess kurtosis. Null under ``least`` rows."""
    spread = F.sqrt(F.greatest(1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe * sharpe, F.lit(floor)))
    return F.when(n >= least, normal_cdf((sharpe - threshold) * F.sqrt(n - 1) / spread))


def luckiest_sharpe(trials: int, gamma: float = 0.5772) -> float:
    """Expected best ratio of ``trials`` strategies without skill (in deviations)."""
    z = NormalDist().inv_cdf
    return (1 - gamma) * z(1 - 1 / trials) + gamma * z(1 - 1 / (trials * math.e)) if trials > 1 else 0.0


def minimum_backtest_length(target: float = 1.0, trials: int = 15, alpha: float = 0.05, gamma: float = 0.5772) -> float:
    """Periods needed before the target ratio beats the best of ``trials`` lucky ones."""
    threshold = luckiest_sharpe(trials, gamma) / math.sqrt(252)
    return math.inf if target <= threshold else (NormalDist().inv_cdf(1 - alpha) / (target - threshold)) ** 2


def sector_attribution(books: DataFrame, weight: str, sector: str, by: Sequence[str]) -> DataFrame:
    """Sector weights and their distance from equal sector weights."""
    own = books.groupBy(*by, sector).agg(F.sum(weight).alias("sector_weight"))
    return own.withColumn("allocation", F.col("sector_weight") - 1 / F.count("*").over(Window.partitionBy(*by)))


def earnings_stability(series: DataFrame, value: str, by: Sequence[str], on: str, rows: int = 12, most: float = 100.0) -> DataFrame:
    """1 / deviation of the growth between the last ``rows`` values, at most ``most``; needs three values and two growths."""
    w = Window.partitionBy(*by).orderBy(F.col(on).desc())
    last = series.filter(F.col(value).isNotNull()).withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= rows)
    before = F.lead(value).over(w)
    grown = last.withColumn("_g", F.when(F.abs(before) > 0.001, (F.col(value) - before) / F.abs(before)))
    sd = F.stddev_samp("_g")
    out = grown.groupBy(*by).agg(F.count(value).alias("values"), F.count("_g").alias("growths"), F.least(F.try_divide(F.lit(1.0), sd), F.lit(most)).alias("stability"))
    return out.filter("values >= 3 and growths >= 2 and stability is not null")


def rescaled_costs(backtest: DataFrame, gross: str, turnover: str, levels: Sequence[float], on: str) -> DataFrame:
    """(basis_points, on, net): the same gross returns under several cost levels."""
    rows = backtest.withColumn("basis_points", F.explode(F.array(*[F.lit(float(b)) for b in levels])))
    return rows.select("basis_points", on, (F.col(gross) - F.col(turnover) * 2 * F.col("basis_points") / 1e4).alias("net"))
