"""Registered queries of whole strategies: arms and their replay, the risk overlay, denoised legs, the two-state model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.operators import crosssection as xs
from marlstone.operators import benchmarks, leaves, quality, regime_model, risk, stats
from marlstone.operators import timeseries as ts
from marlstone.plans import queries as q
from marlstone.plans import views
from marlstone.plans.queries import query, r6
from marlstone.plans.views import with_views
from marlstone.sources.tables import load
from marlstone.session import checkpointed

_FOUR = q._FOUR

# ---------------------------------------------------------------- arms


_ARMS = f""", aw AS (SELECT arm, month, w_momentum::DOUBLE AS w_momentum, w_value::DOUBLE AS w_value, 0.0::DOUBLE AS w_quality, 0.0::DOUBLE AS w_sentiment
  FROM (SELECT DISTINCT month FROM z), (VALUES {", ".join(f"({k}, {m}, {v})" for k, (m, v) in enumerate(leaves.ARMS))}) t(arm, w_momentum, w_value))"""

_CONTEXT = (
    q._REGIME
    + q._DISPERSION
    + f""", ics AS (
  SELECT month, factor, CASE WHEN count(*) >= 5 THEN corr(rx, ry) END AS ic FROM (
    SELECT month, factor, rank() OVER (PARTITION BY month, factor ORDER BY x) + (count(*) OVER (PARTITION BY month, factor, x) - 1) / 2 AS rx,
      rank() OVER (PARTITION BY month, factor ORDER BY y) + (count(*) OVER (PARTITION BY month, factor, y) - 1) / 2 AS ry
    FROM (SELECT z.month, unnest({_FOUR}) AS factor, unnest([{", ".join(_FOUR)}]) AS x, y FROM z JOIN fwd USING (symbol, month)) WHERE x IS NOT NULL AND y IS NOT NULL) GROUP BY 1, 2),
rolled AS (SELECT month, factor, avg(CASE WHEN isnan(ic) THEN NULL ELSE ic END) OVER (PARTITION BY factor ORDER BY month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS ic FROM ics),
ic3 AS (SELECT month, {", ".join(f"coalesce(max(ic) FILTER (factor = '{f}'), 0) AS ic_{f}" for f in _FOUR)} FROM rolled GROUP BY 1),
level AS (SELECT month, coalesce(CASE WHEN count(v) OVER w > 10 THEN (v - avg(v) OVER w) / greatest(stddev_samp(v) OVER w, 1e-6) END, 0) AS level_z FROM gb WINDOW w AS (ORDER BY month ROWS 23 PRECEDING)),
context AS (
  SELECT month, round(level_z, 6) AS level_z, (regime = 'LOW')::INTEGER::DOUBLE AS low, (regime = 'NORMAL')::INTEGER::DOUBLE AS normal, (regime = 'HIGH')::INTEGER::DOUBLE AS high,
    {", ".join(f"round(d_{f}, 6) AS d_{f}" for f in _FOUR)}, {", ".join(f"round(ic_{f}, 6) AS ic_{f}" for f in _FOUR)}
  FROM disp JOIN regime USING (month) JOIN level USING (month) JOIN ic3 USING (month))
"""
)
_ENTRIES = ["level_z", "low", "normal", "high", *(f"d_{f}" for f in _FOUR), *(f"ic_{f}" for f in _FOUR)]


def _rolled_ics(scores: DataFrame, rows: int = 3) -> DataFrame:
    """(month, factor, ic): mean rank correlation of the ``rows`` months before, whose returns are known."""
    ic = xs.information_coefficient(scores, _FOUR, "y", ["month"])
    w = Window.partitionBy("factor").orderBy("month").rowsBetween(-rows, -1)
    return ic.select("month", "factor", F.avg("ic_spearman").over(w).alias("ic"))


def _context(spark: SparkSession, sf_dir: str, scores: DataFrame) -> DataFrame:
    """What is known when a month's weights are chosen: 12 numbers."""
    wide = _rolled_ics(scores).groupBy("month").agg(*[F.coalesce(F.max(F.when(F.col("factor") == f, F.col("ic"))), F.lit(0.0)).alias(f"ic_{f}") for f in _FOUR])
    bench = views.strategy_returns(spark, sf_dir).filter("bench is not null").groupBy("month").agg(F.first("bench").alias("v")).withColumn("one", F.lit(0))
    level = ts.trailing_z(bench, "v", ["one"], "month", rows=24).select("month", F.coalesce("z", F.lit(0.0)).alias("level_z"))
    spread = xs.dispersion(scores, _FOUR, ["month"]).select("month", *[F.col(f).alias(f"d_{f}") for f in _FOUR])
    flags = [(F.col("regime") == r.upper()).cast("double").alias(r) for r in ("low", "normal", "high")]
    both = spread.join(q._market_regime(spark, sf_dir).select("month", *flags), "month").join(level, "month").join(wide, "month")
    return both.select("month", *[r6(c) for c in _ENTRIES])


def _arm_returns(scores: DataFrame) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(k).alias("arm"), F.lit(m).alias("w_momentum"), F.lit(v).alias("w_value"), F.lit(0.0).alias("w_quality"), F.lit(0.0).alias("w_sentiment")) for k, (m, v) in enumerate(leaves.ARMS)])
    weights = scores.select("month").distinct().withColumn("v", F.explode(rows)).select("month", "v.*")
    return q._variant_returns(scores, weights, ["arm"]).select("arm", "month", r6("r", "reward"))


@query(with_views(q._PANEL + _ARMS + q._books_sql("a", "arm") + "SELECT arm, month, round(r, 6) AS reward FROM anum", *q._PANEL_VIEWS))
def bandit_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each arm's book would have earned, net of its own costs, in every month: one plan for all arms."""
    return _arm_returns(checkpointed(q._scores(spark, sf_dir)))


@query(with_views(q._PANEL + _CONTEXT + f"SELECT month, {', '.join(_ENTRIES)} FROM context", *q._PANEL_VIEWS, "strategy_returns"))
def bandit_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 12 numbers that a month's arm is chosen by."""
    return _context(spark, sf_dir, checkpointed(q._scores(spark, sf_dir)))


def _replayed(spark: SparkSession, sf_dir: str, seeds: int = 20) -> DataFrame:
    scores = checkpointed(q._scores(spark, sf_dir))
    paid = _arm_returns(scores).groupBy("month").agg(F.transform(F.sort_array(F.collect_list(F.struct("arm", "reward"))), lambda x: x["reward"]).alias("rewards"))
    dates = _context(spark, sf_dir, scores).select("month", F.array(*_ENTRIES).alias("context")).join(paid, "month")
    seeded = dates.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))))
    return leaves.bandit_replay(seeded, "context", "rewards", ["seed"], "month", "seed")


@query()
def bandit_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty seeds' replays over arms, rewards and contexts."""
    return _replayed(spark, sf_dir)


@query()
def bandit_arm_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each arm was played, what it earned, and what the best arm would have."""
    return _replayed(spark, sf_dir).groupBy("seed", "arm").agg(F.count("*").alias("n"), r6(F.sum("reward"), "reward"), r6(F.sum(F.col("best") - F.col("reward")), "regret"))


# ---------------------------------------------------------------- risk overlay

_TRAIL_DAYS = 1096
_OVERLAY = (
    q._REGIME
    + q._DISPERSION
    + q._dynamic_sql("vw", "variant", f"SELECT * FROM (VALUES {', '.join(f"('{k}', {g}::DOUBLE, {x}::DOUBLE)" for k, (g, x) in q._COMPARED.items())}) t(variant, gamma, lam)")
    + q._books_sql("v", "variant")
    + f""", daily AS (SELECT symbol, day, px / lag(px) OVER (PARTITION BY symbol ORDER BY day) - 1 AS ret FROM (SELECT l_suppkey AS symbol, l_shipdate::DATE AS day, round(avg(l_extendedprice / l_quantity), 6) AS px FROM lineitem GROUP BY 1, 2)),
trail AS (SELECT variant, month, day, sum(weight * coalesce(ret, 0)) AS r FROM vbook JOIN daily USING (symbol) WHERE day < month AND day >= month - {_TRAIL_DAYS} GROUP BY ALL),
tq AS (SELECT variant, month, count(r) AS n, quantile_cont(r, 0.01) AS q FROM trail GROUP BY ALL),
es AS (SELECT variant, month, avg(r) FILTER (r <= q) AS es FROM trail JOIN tq USING (variant, month) GROUP BY ALL),
late AS (SELECT variant, month, stddev_samp(r) AS sd, count(r) AS n60 FROM (SELECT *, row_number() OVER (PARTITION BY variant, month ORDER BY day DESC) AS b FROM trail) WHERE b <= 60 GROUP BY ALL),
scal AS (
  SELECT variant, month, n, CASE WHEN n >= 30 THEN -q ELSE 0.02 END AS var, CASE WHEN n >= 30 THEN -es ELSE 0.025 END AS es,
    CASE WHEN n < 30 THEN 1 WHEN -q > 0 THEN 0.02 / -q ELSE 1 END AS var_scalar, CASE WHEN n60 < 10 OR sd IS NULL OR sd = 0 THEN 1 ELSE greatest(least(0.1 / (sd * sqrt(252)), 1.5), 0.3) END AS vol_scalar
  FROM tq JOIN es USING (variant, month) JOIN late USING (variant, month))
"""
)
_FED_BACK = """, dates AS (
  SELECT variant, month, k, gross_ret, [least(greatest(least(b * l, 2), 0), 2 / g) FOR l IN [1, 0.75, 0.5]] AS s FROM (
    SELECT variant, month, k, any_value(coalesce(var_scalar * vol_scalar, 1)) AS b, sum(weight * coalesce(y, 0)) AS gross_ret, sum(abs(weight)) AS g
    FROM vbook LEFT JOIN fwd USING (symbol, month) LEFT JOIN scal USING (variant, month) GROUP BY ALL)),
sides AS (SELECT variant, k, symbol, sum(n) AS n, sum(o) AS o FROM (SELECT variant, k, symbol, weight AS n, 0.0 AS o FROM vbook UNION ALL SELECT variant, k + 1, symbol, 0.0, weight FROM vbook) GROUP BY ALL),
lv AS (SELECT unnest([1, 2, 3]) AS i),
tt AS (SELECT a.variant, a.k, x.i AS i, y.i AS j, sum(abs(n * a.s[x.i] - o * coalesce(b.s[y.i], 0))) / 2 AS t
  FROM sides JOIN dates a USING (variant, k) LEFT JOIN dates b ON b.variant = sides.variant AND b.k = sides.k - 1, lv x, lv y GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY k) AS i FROM dates),
path(variant, i, navs, level, drawdown, scale, turnover, net) AS (
  SELECT DISTINCT variant, 0::BIGINT, [1.0::DOUBLE], 1, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM dates
  UNION ALL
  SELECT c.variant, c.i, list_append(c.navs, c.navs[-1] * (1 + c.s[c.l] * c.gross_ret - t.t * 0.004)), c.l, c.d, c.s[c.l], t.t, c.s[c.l] * c.gross_ret - t.t * 0.004 FROM (
    SELECT p.variant, d.i, d.k, d.s, d.gross_ret, p.navs, p.level, p.navs[-1] / list_max(p.navs[-13:]) - 1 AS d, CASE WHEN p.navs[-1] / list_max(p.navs[-13:]) - 1 <= -0.06 THEN 3 WHEN p.navs[-1] / list_max(p.navs[-13:]) - 1 <= -0.03 THEN 2 ELSE 1 END AS l
    FROM path p JOIN placed d ON d.variant = p.variant AND d.i = p.i + 1) c JOIN tt t ON t.variant = c.variant AND t.k = c.k AND t.i = c.l AND t.j = c.level)
SELECT variant, month, round(drawdown, 6) AS drawdown, round(scale, 6) AS scale, round(turnover, 6) AS turnover, round(net, 6) AS net, round(navs[-1], 6) AS nav FROM path JOIN placed USING (variant, i)"""


def _compared_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books of fixed and dynamic weights, written once: scalars, steps and changes all read them."""
    scores = checkpointed(q._scores(spark, sf_dir))
    cells = F.array(*[F.struct(F.lit(k).alias("variant"), F.lit(g).alias("gamma"), F.lit(x).alias("lam")) for k, (g, x) in q._COMPARED.items()])
    return checkpointed(q._variant_books(scores, q._dynamic(spark, sf_dir, scores, cells, ("variant",)), ["variant"]).drop("y"))


def _scalars(spark: SparkSession, sf_dir: str, books: DataFrame) -> DataFrame:
    days = views.prices_by_day(spark, sf_dir)
    daily = days.select("symbol", "day", (F.try_divide(F.col("px"), F.lag("px").over(Window.partitionBy("symbol").orderBy("day"))) - 1).alias("ret"))
    trail = checkpointed(risk.trailing_book_returns(books, daily, ["variant"], "month", _TRAIL_DAYS))
    return risk.risk_scalars(trail, ["variant", "month"])


@query(with_views(q._PANEL + _OVERLAY + "SELECT variant, month, n, round(var, 6) AS var, round(es, 6) AS es, round(var_scalar, 6) AS var_scalar, round(vol_scalar, 6) AS vol_scalar FROM scal", *q._PANEL_VIEWS, "strategy_returns"))
def risk_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value at risk, shortfall and the exposure they allow, from three years of daily returns of each month's book."""
    return _scalars(spark, sf_dir, _compared_books(spark, sf_dir)).select("variant", "month", "n", r6("var"), r6("es"), r6("var_scalar"), r6("vol_scalar"))


@query(with_views(q._PANEL + _OVERLAY + _FED_BACK, *q._PANEL_VIEWS, "strategy_returns").replace("WITH ", "WITH RECURSIVE ", 1))
def risk_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books scaled by value at risk, volatility and their own drawdown, with turnover, net return and NAV of the scaled book."""
    books = _compared_books(spark, sf_dir)
    ahead = q._forward(spark, sf_dir).select("symbol", "month", "y")
    steps = risk.overlay_steps(books, ahead, _scalars(spark, sf_dir, books), ["variant"], "month", "k")
    return risk.overlaid(steps, ["variant"], "month", "k").select("variant", "month", r6("drawdown"), r6("scale"), r6("turnover"), r6("net"), r6("nav"))


# ---------------------------------------------------------------- denoised legs


def _leg_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q._returns(spark, sf_dir).filter("ret is not null").join(views.universe(spark, sf_dir), "symbol")


@query()
def denoised_covariances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sector's covariance without the eigenvalues of noise, with the edge they lie below."""
    return leaves.leg_covariances(_leg_returns(spark, sf_dir), ["sector"], "symbol", "month", "ret")


@query()
def denoised_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minimum-variance legs on denoised covariances."""
    return leaves.leg_weights(_leg_returns(spark, sf_dir), ["sector"], "symbol", "month", "ret", method="denoised").select("sector", "symbol", r6("weight"))


# ---------------------------------------------------------------- two-state regimes


@query()
def two_state_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each priority's weekly order value at every month's start, by a model fitted to what was known."""
    o = load(spark, sf_dir, "orders")
    week = F.to_date(F.date_trunc("week", "o_orderdate"))
    weekly = o.groupBy(F.col("o_orderpriority").alias("strategy"), week.alias("week")).agg(F.avg("o_totalprice").alias("level"))
    months = o.select(F.trunc("o_orderdate", "MM").alias("month")).distinct()
    return regime_model.two_state_regimes(weekly, "level", ["strategy"], "week", months).select("strategy", F.col("as_of").alias("month"), "n", r6("probability"), "regime")


# ---------------------------------------------------------------- capacity and checks of books


@query(
    with_views(
        q._FLAGSHIP
        + """, dd AS (SELECT symbol, day, px * volume AS dollars, px / lag(px) OVER (PARTITION BY symbol ORDER BY day) - 1 AS ret FROM (
  SELECT l_suppkey AS symbol, l_shipdate::DATE AS day, round(avg(l_extendedprice / l_quantity), 6) AS px, sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2)),
liq AS (SELECT symbol, avg(abs(ret) / nullif(dollars, 0)) AS ill, avg(dollars) AS adv FROM dd GROUP BY 1)
SELECT month, round(min(CASE WHEN abs(weight) > 1e-6 AND ill > 0 THEN 15 / (abs(weight) * ill * 1e4) END), 2) AS max_aum, count(*) FILTER (abs(weight) > 1e-6) AS n_stocks,
  round(median(ill) * 1e6, 6) AS median_illiquidity, round(sum(abs(weight) * 1e6 * ill * 1e4), 6) AS impact_bp
FROM book JOIN liq USING (symbol) GROUP BY 1""",
        *q._PANEL_VIEWS,
    )
)
def book_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest fund that each month's book can carry within 15 basis points a name, and its impact at a million."""
    days = load(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("day")).agg(F.round(F.avg(F.col("l_extendedprice") / F.col("l_quantity")), 6).alias("px"), F.sum("l_quantity").alias("volume"))
    change = F.try_divide(F.col("px"), F.lag("px").over(Window.partitionBy("symbol").orderBy("day"))) - 1
    liquid = stats.amihud(days.select("symbol", (F.col("px") * F.col("volume")).alias("dollars"), change.alias("ret")), "ret", "dollars", ["symbol"])
    frame = stats.capacity_frame(q._book(spark, sf_dir), liquid, "weight", ["symbol"])
    out = stats.capacity(frame, "weight", "illiquidity", ["month"])
    return out.select("month", F.round("max_aum", 2).alias("max_aum"), "n_stocks", r6(F.col("median_illiquidity") * 1e6, "median_illiquidity"), r6("impact_bp"))


@query(
    with_views(
        q._FLAGSHIP
        + """, bw AS (SELECT month, count(*) FILTER ((side = 1 AND weight < 0) OR (side = -1 AND weight > 0)) AS wrong_sign, count(*) FILTER (abs(weight) > 0.1 + 1e-9) AS over_cap FROM book GROUP BY 1)
SELECT month, wrong_sign, over_cap, wrong_sign = 0 AND over_cap = 0 AS valid, ws.rows, ws.missing, ws.extreme FROM bw JOIN (
  SELECT month, count(*) AS rows, count(*) FILTER (y IS NULL) AS missing, count(*) FILTER (abs(y) > 0.5) AS extreme FROM book LEFT JOIN fwd USING (symbol, month) GROUP BY 1) ws USING (month)""",
        *q._PANEL_VIEWS,
    )
)
def book_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each month's book: weights of the wrong sign or over a tenth, and returns that are missing or beyond a half."""
    book = q._book(spark, sf_dir).withColumn("leg", F.when(F.col("weight") >= 0, "long").otherwise("short"))
    ahead = book.join(q._forward(spark, sf_dir).select("symbol", "month", "y"), ["symbol", "month"], "left")
    return quality.validate_weights(book, "weight", "leg", ["month"], 0.1).join(quality.validate_returns(ahead, "y", ["month"]), "month")


# ---------------------------------------------------------------- benchmarks and legs


@query(
    with_views(
        q._FLAGSHIP
        + """, uni AS (SELECT month, avg(coalesce(y, 0)) AS bench FROM fwd GROUP BY 1)
SELECT month, CASE side WHEN 1 THEN 'long' ELSE 'short' END AS leg, round(sum(abs(weight) / g * coalesce(y, 0)), 6) AS leg_return, round(sum(abs(weight) / g * coalesce(y, 0)) - any_value(bench), 6) AS leg_alpha
FROM (SELECT *, sum(abs(weight)) OVER (PARTITION BY month, side) AS g FROM book) b LEFT JOIN fwd USING (symbol, month) JOIN uni USING (month) GROUP BY month, side""",
        *q._PANEL_VIEWS,
    )
)
def leg_alphas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each leg's return at full weight, and what it is beyond the mean of all symbols."""
    ahead = q._forward(spark, sf_dir).select("symbol", "month", "y")
    universe = ahead.groupBy("month").agg(F.avg(F.coalesce("y", F.lit(0.0))).alias("bench"))
    legs = q._book(spark, sf_dir).withColumn("leg", F.when(F.col("weight") >= 0, "long").otherwise("short"))
    paid = legs.join(ahead, ["symbol", "month"], "left").groupBy("month", "leg").agg((F.sum(F.abs("weight") * F.coalesce("y", F.lit(0.0))) / F.sum(F.abs("weight"))).alias("leg_return"))
    return paid.join(universe, "month").select("month", "leg", r6("leg_return"), r6(F.col("leg_return") - F.col("bench"), "leg_alpha"))


@query(
    (
        """WITH days AS (SELECT o_orderdate::DATE AS day, round(avg(o_totalprice), 6) AS close FROM orders GROUP BY 1),
idx AS (SELECT date_trunc('month', day)::DATE AS month, round(arg_max(close, day) / arg_min(close, day) - 1, 6) AS index_return FROM days GROUP BY 1),
rates AS (SELECT l_shipdate::DATE AS day, round(avg(l_tax), 6) AS rate FROM lineitem GROUP BY 1),
rf AS (SELECT month, coalesce(arg_max(rate, rates.day), 0) AS rf FROM idx LEFT JOIN rates ON rates.day < month GROUP BY 1)
SELECT month, index_return, round(rf, 6) AS rf, round(0.5 * (pow(1 + rf, 1 / 12) - 1) + 0.5 * index_return, 6) AS blend FROM idx JOIN rf USING (month)"""
    )
)
def index_and_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index's return from a month's first to its last day, the latest riskless rate before the month, and half of each."""
    days = load(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.round(F.avg("o_totalprice"), 6).alias("close"))
    index = days.groupBy(F.trunc("day", "MM").alias("month")).agg(F.round(F.try_divide(F.max_by("close", "day"), F.min_by("close", "day")) - 1, 6).alias("index_return"))
    rates = load(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.round(F.avg("l_tax"), 6).alias("rate"))
    both = benchmarks.latest_rate(index, rates, "month", "day", "rate")
    return both.select("month", "index_return", r6("rf"), r6(benchmarks.cash_market_blend(F.col("rf"), F.col("index_return"), 1), "blend"))
