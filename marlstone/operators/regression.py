"""Least squares on any number of columns, one fit a group, solved inside Spark.

Cross products are sums, so a group's rows are combined before they are
shuffled; the normal equations of a group are a small array of arrays, and
higher-order functions eliminate it without leaving the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.stats import normal_cdf

#: A pivot of scaled cross products (1 on the diagonal) below this means that a column is a combination of others.
_SINGULAR = 1e-10


def inverse(matrix: Column, size: int) -> Column:
    """The inverse of a symmetric positive definite array of ``size`` rows; null where it has none.

    Gauss-Jordan elimination, one step of an ``aggregate`` for each diagonal
    element, on the matrix scaled to a unit diagonal.
    """
    scale = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.sqrt(F.get(F.get(matrix, i), i)))
    unit = F.array(*[F.array(*[F.lit(float(i == j)) for j in range(size)]) for i in range(size)])
    scaled = F.transform(matrix, lambda row, i: F.zip_with(row, scale, lambda v, s: F.try_divide(v, s * F.get(scale, i))))
    start = F.zip_with(scaled, unit, lambda a, b: F.concat(a, b))

    def eliminate(m: Column, p: Column) -> Column:
        pivot = F.get(F.get(m, p), p)
        lead = F.transform(F.get(m, p), lambda v: F.when(pivot > _SINGULAR, v / pivot))
        return F.transform(m, lambda row, i: F.when(i == p, lead).otherwise(F.zip_with(row, lead, lambda v, d: v - F.get(row, p) * d)))

    done = F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), start, eliminate)
    back = F.transform(done, lambda row, i: F.zip_with(F.slice(row, size + 1, size), scale, lambda v, s: v / (s * F.get(scale, i))))
    return F.when(~F.exists(back, lambda row: F.exists(row, lambda v: v.isNull())), back)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def _symmetric(cells: dict[tuple[int, int], Column], size: int) -> Column:
    return F.array(*[F.array(*[cells[min(i, j), max(i, j)] for j in range(size)]) for i in range(size)])


def _products(x: Sequence[Column], y: Column) -> list[Column]:
    """Sums of all products of regressors and y: _xx (array of arrays), _xy, _yy, _sy, n."""
    k = len(x)
    cells = {(i, j): F.sum(x[i] * x[j]) for i in range(k) for j in range(i, k)}
    return [_symmetric(cells, k).alias("_xx"), F.array(*[F.sum(v * y) for v in x]).alias("_xy"), F.sum(y * y).alias("_yy"), F.sum(y).alias("_sy"), F.count("*").alias("n")]


def _whole(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with a finite value in every column, as doubles."""
    out = df.withColumns({c: F.col(c).cast("double") for c in columns})
    for c in columns:
        out = out.filter(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return out


def cross_section_fit(df: DataFrame, x: Sequence[str], y: str, by: Sequence[str], least: int = 10) -> DataFrame:
    """Slopes of y on any number of columns without an intercept, per group: beta_x, t_x (equal variances), R squared about the mean.

    Rows with a null or not finite value are left out, and groups under
    ``least`` rows; slopes are null where a column is a combination of others, t values where there are no
    more rows than columns. One aggregation, whose groups may be of any size.
    """
    k = len(x)
    sums = _whole(df, [*x, y]).groupBy(*by).agg(*_products([F.col(c) for c in x], F.col(y))).filter(F.col("n") >= least)
    fit = sums.withColumn("_inv", inverse(F.col("_xx"), k))
    fit = fit.withColumn("_beta", F.transform("_inv", lambda row: _dot(row, F.col("_xy"))))
    fit = fit.withColumn("_left", F.greatest(F.col("_yy") - _dot(F.col("_beta"), F.col("_xy")), F.lit(0.0)))
    noise = F.when(F.col("n") > k, F.col("_left") / (F.col("n") - k))

    def t(i: int) -> Column:
        return F.try_divide(F.get("_beta", F.lit(i)), F.sqrt(noise * F.get(F.get("_inv", F.lit(i)), F.lit(i))))

    return fit.select(
        *by,
        "n",
        *[F.get("_beta", F.lit(i)).alias(f"beta_{c}") for i, c in enumerate(x)],
        *[t(i).alias(f"t_{c}") for i, c in enumerate(x)],
        (1 - F.try_divide(F.col("_left"), F.col("_yy") - F.col("_sy") * F.col("_sy") / F.col("n"))).alias("r_squared"),
    )


def hac_fit(series: DataFrame, x: Sequence[str], y: str, by: Sequence[str], on: str, lags: int = 4, least: int = 10, z: float = 1.96) -> DataFrame:
    """Regression of y on an intercept and any number of columns, per series, with Newey-West errors: one row per coefficient.

    (by, factor, beta, se, t, p, low, high, r_squared, n); the intercept's
    factor is ``alpha``, p is two-sided and normal, low and high are beta -+ z
    se. The lag-weighted sum of score products is a k x k matrix like the
    cross products, summed over rows and their ``lags`` predecessors in order of
    ``on``. Rows with a null or not finite value are left out before lags are counted,
    and series under ``least`` rows; beta is null where a column is constant or a combination of others. A series
    is one sorted window, so it must fit a task; sums are combined before they are shuffled.
    """
    k, names = len(x) + 1, ["alpha", *x]
    rows = _whole(series, [*x, y])
    vector = F.array(F.lit(1.0), *[F.col(c) for c in x])
    sums = rows.groupBy(*by).agg(*_products([F.lit(1.0), *[F.col(c) for c in x]], F.col(y))).filter(F.col("n") >= least)
    fit = sums.withColumn("_inv", inverse(F.col("_xx"), k))
    fit = fit.withColumn("_beta", F.transform("_inv", lambda row: _dot(row, F.col("_xy"))))
    scored = rows.join(fit.select(*by, "_beta"), list(by))
    error = F.col(y) - _dot(F.col("_beta"), vector)
    order = Window.partitionBy(*by).orderBy(on)
    scored = scored.select(*by, on, error.alias("_e"), vector.alias("_v")).withColumn("_u", F.transform("_v", lambda v: v * F.col("_e")))
    scored = scored.withColumns({f"_u{lag}": F.lag("_u", lag).over(order) for lag in range(1, lags + 1)})

    def meat(i: int, j: int) -> Column:
        total = F.get("_u", F.lit(i)) * F.get("_u", F.lit(j))
        for lag in range(1, lags + 1):
            before = f"_u{lag}"
            both = F.get("_u", F.lit(i)) * F.get(before, F.lit(j)) + F.get(before, F.lit(i)) * F.get("_u", F.lit(j))
            total = total + (1 - lag / (lags + 1)) * F.coalesce(both, F.lit(0.0))
        return F.sum(total)

    meats = scored.groupBy(*by).agg(_symmetric({(i, j): meat(i, j) for i in range(k) for j in range(i, k)}, k).alias("_meat"), F.sum(F.col("_e") * F.col("_e")).alias("_left"))
    both = fit.join(meats, list(by))

    def variance(row: Column) -> Column:
        """row meat row', for a row of the inverse."""
        return _dot(row, F.transform("_meat", lambda m: _dot(m, row)))

    both = both.withColumn("_se", F.transform("_inv", lambda row: F.sqrt(F.greatest(variance(row), F.lit(0.0)))))
    both = both.withColumn("r_squared", 1 - F.try_divide(F.col("_left"), F.col("_yy") - F.col("_sy") * F.col("_sy") / F.col("n")))
    cells = F.array(*[F.struct(F.lit(c).alias("factor"), F.get("_beta", F.lit(i)).alias("beta"), F.get("_se", F.lit(i)).alias("se")) for i, c in enumerate(names)])
    long = both.select(*by, "n", "r_squared", F.explode(cells).alias("f")).select(*by, "n", "r_squared", "f.*")
    long = long.withColumn("t", F.try_divide(F.col("beta"), F.col("se")))
    return long.select(*by, "factor", "beta", "se", "t", (2 * (1 - normal_cdf(F.abs("t")))).alias("p"), (F.col("beta") - z * F.col("se")).alias("low"), (F.col("beta") + z * F.col("se")).alias("high"), "r_squared", "n")


def month_end_join(five: DataFrame, momentum: DataFrame, month: str, ym: str = "ym") -> DataFrame:
    """Monthly factor tables, one dated by numbers like 202401 and in percent, the other by any day of the month, as decimals on month ends that both have."""
    last = F.last_day(F.to_date(F.col(ym).cast("string"), "yyyyMM"))
    decimals = [(F.col(c) / 100).alias(c) for c in five.columns if c != ym]
    left = five.select(last.alias("month_end"), *decimals)
    right = momentum.select(F.last_day(month).alias("month_end"), *[(F.col(c) / 100).alias(c) for c in momentum.columns if c != month])
    return left.join(right, "month_end")


def compounded(monthly: Column, periods: int = 12) -> Column:
    """A monthly rate as a yearly one."""
    return F.pow(1 + monthly, F.lit(periods)) - 1
