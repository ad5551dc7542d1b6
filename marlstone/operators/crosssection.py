"""Cross-sections of factor scores: group-wise scaling, composites, ranks and legs.

A group is one date's cross-section, or a sector of it, and so holds at most
the universe's symbols; windows over groups need one shuffle for a whole chain
of steps with the same keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.scalars import clipped, guarded_corr


def winsorised(df: DataFrame, values: Sequence[str], by: Sequence[str], low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Values clipped to the group's exact quantiles (linear interpolation)."""
    w = Window.partitionBy(*by)
    bounds = df.withColumns({f"_{v}_q": F.percentile(v, F.lit([low, high])).over(w) for v in values})
    return bounds.withColumns({v: clipped(F.col(v), F.col(f"_{v}_q")[0], F.col(f"_{v}_q")[1]) for v in values}).drop(*[f"_{v}_q" for v in values])


def zscored(df: DataFrame, values: Sequence[str], by: Sequence[str], least: int = 5) -> DataFrame:
    """(x - mean) / population deviation in the group; 0 in groups under ``least`` rows or without spread."""
    w = Window.partitionBy(*by)

    def z(v: str) -> Column:
        sd = F.stddev_pop(v).over(w)
        flat = (F.count(v).over(w) < least) | sd.isNull() | (sd == 0)
        return F.when(F.col(v).isNotNull(), F.when(flat, F.lit(0.0)).otherwise(F.try_divide(F.col(v) - F.avg(v).over(w), sd)))

    return df.withColumns({v: z(v) for v in values})


def residualised(df: DataFrame, factors: Sequence[str], by: Sequence[str], least: int = 5) -> DataFrame:
    """Each factor without its projections on the factors before it, by group and without an intercept.

    Residuals of complete rows are orthogonal to each other, so the joint
    regression is one projection per earlier factor and needs group sums only.
    Rows with a null factor, and groups of fewer than ``least`` complete rows,
    keep their raw values; a factor of zero length takes no projection.
    """
    w = Window.partitionBy(*by)
    whole = F.lit(True)
    for f in factors:
        whole = whole & F.col(f).isNotNull()
    out = df.withColumn("_whole", whole).withColumn("_n", F.count_if("_whole").over(w))
    done: list[str] = []
    for f in factors:
        shift: Column = F.lit(0.0)
        for d in done:
            xy = F.sum(F.when(F.col("_whole"), F.col(f) * F.col(d))).over(w)
            xx = F.sum(F.when(F.col("_whole"), F.col(d) * F.col(d))).over(w)
            shift = shift + F.coalesce(F.try_divide(xy, xx), F.lit(0.0)) * F.col(d)
        out = out.withColumn(f, F.when(F.col("_whole") & (F.col("_n") >= least), F.col(f) - shift).otherwise(F.col(f)))
        done.append(f)
    return out.drop("_whole", "_n")


def composite(df: DataFrame, weights: dict[str, float | Column], by: Sequence[str], name: str = "composite") -> DataFrame:
    """Sum of weight * z with null as 0; the weight of factors that nobody in the group has goes to the others.

    A weight may be a column that is constant in a group.
    """
    w = Window.partitionBy(*by)
    missing: Column = F.lit(0.0)
    total: Column = F.lit(0.0)
    for f, weight in weights.items():
        weight = weight if isinstance(weight, Column) else F.lit(weight)
        missing = missing + F.when(F.count(f).over(w) == 0, weight).otherwise(0.0)
        total = total + F.coalesce(F.col(f), F.lit(0.0)) * weight
    out = df.withColumn("_missing", missing)
    scale = F.when((F.col("_missing") > 0) & (F.col("_missing") < 0.999), 1 / (1 - F.col("_missing"))).otherwise(1.0)
    return out.withColumn(name, total * scale).drop("_missing")


def row_mean(columns: Sequence[str]) -> Column:
    """Mean of the values that aren't null."""
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in columns), F.lit(0.0))
    return F.try_divide(total, sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0)))


def information_coefficient(df: DataFrame, factors: Sequence[str], forward: str, by: Sequence[str], least: int = 5) -> DataFrame:
    """Per group and factor: Spearman and Pearson correlation with the forward return, and rows; null under ``least`` rows or where one side is constant."""
    long = df.select(*by, F.col(forward).alias("_y"), F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).cast("double").alias("_x")) for f in factors])).alias("_f"))
    long = long.select(*by, "_f.factor", "_f._x", "_y").filter("_x is not null and _y is not null")
    keys = [*by, "factor"]

    def average_rank(c: str) -> Column:
        return F.rank().over(Window.partitionBy(*keys).orderBy(c)) + (F.count("*").over(Window.partitionBy(*keys, c)) - 1) / 2

    ranked = long.withColumn("_rx", average_rank("_x")).withColumn("_ry", average_rank("_y"))
    n = F.count("*")
    return ranked.groupBy(*keys).agg(
        F.when(n >= least, guarded_corr("_rx", "_ry")).alias("ic_spearman"),
        F.when(n >= least, guarded_corr("_x", "_y")).alias("ic_pearson"),
        n.alias("n"),
    )


def dispersion(df: DataFrame, values: Sequence[str], by: Sequence[str], share: float = 0.25, least: int = 10) -> DataFrame:
    """Mean above the upper quantile minus mean below the lower one, per group and factor; 0 under ``least`` rows."""
    w = Window.partitionBy(*by)
    out = df.withColumns({f"_{v}_q": F.percentile(v, F.lit([share, 1 - share])).over(w) for v in values})
    cells = [F.when(F.count(v) >= least, F.avg(F.when(F.col(v) >= F.col(f"_{v}_q")[1], F.col(v))) - F.avg(F.when(F.col(v) <= F.col(f"_{v}_q")[0], F.col(v)))).otherwise(0.0).alias(v) for v in values]
    return out.groupBy(*by).agg(*cells)


def dynamic_weights(base: dict[str, float], spread: DataFrame, regime: DataFrame, by: Sequence[str], tilt: dict[str, dict[str, float]], gamma: float | Column = 0.5, lam: float | Column = 0.5, keep: Sequence[str] = ()) -> DataFrame:
    """w (1 + lambda tilt)(1 + gamma dispersion), not below 0, adding up to 1; one row per group (of ``spread``, whose columns ``keep`` stay)."""
    joined = spread.join(regime, list(by))
    raw = {}
    for f, w in base.items():
        lean = F.coalesce(*[F.when(F.col("regime") == r, F.lit(t.get(f, 0.0))) for r, t in tilt.items()], F.lit(0.0))
        raw[f] = F.greatest(F.lit(w) * (1 + lam * lean) * (1 + gamma * F.col(f)), F.lit(0.0))
    total = sum(raw.values(), F.lit(0.0))
    return joined.select(*by, *keep, "regime", *[F.coalesce(F.try_divide(c, total), F.lit(w)).alias(f"w_{f}") for (f, c), w in zip(raw.items(), base.values())])


def legs(df: DataFrame, score: str, by: Sequence[str], share: float = 0.2, band: float = 0.05) -> DataFrame:
    """Adds core and band membership of the long and short legs, by the group's score quantiles."""
    points = [share, share + band, 1 - share - band, 1 - share]
    out = df.withColumn("_q", F.percentile(score, F.lit(points)).over(Window.partitionBy(*by)))
    s = F.col(score)
    return (
        out.withColumn("short_core", s <= F.col("_q")[0])
        .withColumn("short_band", s <= F.col("_q")[1])
        .withColumn("long_band", s >= F.col("_q")[2])
        .withColumn("long_core", s >= F.col("_q")[3])
        .drop("_q")
    )


def absolute_momentum(legs: DataFrame, momentum: str, long: Sequence[str] = ("long_core", "long_band")) -> DataFrame:
    """Long membership only where momentum is known and above 0."""
    rises = F.coalesce(F.col(momentum) > 0, F.lit(False))
    return legs.withColumns({c: F.col(c) & rises for c in long})


def held_members(df: DataFrame, core: str, stay: str, by: Sequence[str], on: str, name: str) -> DataFrame:
    """Membership with hysteresis: in from a date in the core until the first date that isn't in the band.

    Within each unbroken run of band dates a symbol is a member from its first
    core date on, so the recurrence is a running maximum over islands. ``on``
    numbers the calendar's dates without gaps; a missing date ends a run.
    """
    w = Window.partitionBy(*by).orderBy(on)
    inside = F.coalesce(F.col(stay), F.lit(False))
    broke = (~F.coalesce(F.lag(inside).over(w), F.lit(False)) | (F.lag(on).over(w) != F.col(on) - 1)).cast("int")
    runs = df.withColumn("_in", inside).withColumn("_b", F.when(F.col("_in"), broke).otherwise(1)).withColumn("_run", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = Window.partitionBy(*by, "_run").orderBy(on).rowsBetween(Window.unboundedPreceding, 0)
    member = F.col("_in") & (F.max(F.coalesce(F.col(core), F.lit(False)).cast("int")).over(first) == 1)
    return runs.withColumn(name, member).drop("_in", "_b", "_run")
