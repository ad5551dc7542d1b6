"""Registered queries of small reports and of cleaned feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import crosssection as xs
from marlstone.operators import regression, relational, stats
from marlstone.operators import timeseries as ts
from marlstone.plans import queries as q
from marlstone.plans import strategies, views
from marlstone.plans.queries import query, r6
from marlstone.plans.views import with_views
from marlstone.sources import cleaners
from marlstone.sources.tables import load

_FOUR = q._FOUR


@query(
    """WITH t AS (SELECT l_suppkey AS symbol, l_orderkey, l_linenumber, l_shipdate::DATE AS cob_date, l_extendedprice AS o, l_extendedprice * (1 + l_tax) AS h, l_extendedprice * (1 - l_discount) AS l, l_quantity AS v FROM lineitem),
c AS (SELECT *, CASE WHEN l_linenumber = 1 THEN l ELSE h END AS hi, CASE WHEN l_linenumber = 1 THEN h ELSE l END AS lo FROM t)
SELECT symbol, cob_date, count(*) AS n, round(sum(o), 4) AS open_price, round(sum(greatest(hi, lo)), 4) AS high_price, round(sum(least(hi, lo)), 4) AS low_price, count(*) FILTER (l_orderkey % 7 <> 0) AS closes, sum(v)::BIGINT AS volume
FROM c WHERE l_orderkey % 11 <> 0 GROUP BY 1, 2"""
)
def price_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed's price rows as texts, with wrong dates, crossed highs and lows and closes that are no numbers, as typed rows."""
    li = load(spark, sf_dir, "lineitem")
    o, high, low = F.col("l_extendedprice"), F.col("l_extendedprice") * (1 + F.col("l_tax")), F.col("l_extendedprice") * (1 - F.col("l_discount"))
    crossed, text = F.col("l_linenumber") == 1, lambda c: c.cast("string")
    raw = li.select(
        F.col("l_suppkey").alias("x|Symbol"), F.when(F.col("l_orderkey") % 11 == 0, "n/a").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd 00:00:00")).alias("x|Date"), text(o).alias("x|Open"),
        text(F.when(crossed, low).otherwise(high)).alias("x|High"), text(F.when(crossed, high).otherwise(low)).alias("x|Low"), F.when(F.col("l_orderkey") % 7 == 0, "nan").otherwise(text(o)).alias("x|Close"), text(F.col("l_quantity")).alias("x|Volume"),
    )
    clean = cleaners.clean_prices(raw, F.col("symbol"), F.lit("USD"))
    four = lambda c: F.round(F.sum(c), 4).alias(c)
    return clean.groupBy("symbol", "cob_date").agg(F.count("*").alias("n"), four("open_price"), four("high_price"), four("low_price"), F.count("close_price").alias("closes"), F.sum("volume").alias("volume"))


@query(
    with_views(
        q._FLAGSHIP
        + """, uni AS (SELECT month, avg(coalesce(y, 0)) AS bench FROM fwd GROUP BY 1),
legs AS (SELECT month, side, sum(abs(weight) / g * coalesce(y, 0)) - any_value(bench) AS alpha FROM (SELECT *, sum(abs(weight)) OVER (PARTITION BY month, side) AS g FROM book) b LEFT JOIN fwd USING (symbol, month) JOIN uni USING (month) GROUP BY month, side)
SELECT year(month)::INTEGER AS year, CASE side WHEN 1 THEN 'long' ELSE 'short' END AS leg, count(*) AS months, round(sum(round(alpha, 6)), 6) AS alpha FROM legs GROUP BY 1, 2""",
        *q._PANEL_VIEWS,
    )
)
def annual_leg_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strategies.leg_alphas(spark, sf_dir).groupBy(F.year("month").alias("year"), "leg").agg(F.count("*").alias("months"), r6(F.sum("leg_alpha"), "alpha"))


@query(
    with_views(
        q._FORWARD_SQL
        + """, b AS (SELECT year(month)::INTEGER AS year, sum(m) AS momentum, sum(v) AS reversal FROM f GROUP BY 1) SELECT year, round(momentum, 6) AS momentum, round(reversal, 6) AS reversal, round(momentum + reversal, 6) AS total FROM b""",
        "returns",
    )
)
def annual_factor_premia(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each year's sum of the factors' monthly premia, a column for each, and their total."""
    betas = regression.cross_section_fit(q._forward(spark, sf_dir), ["momentum", "reversal"], "y", ["month"])
    sums = betas.groupBy(F.year("month").alias("year")).agg(F.sum("beta_momentum").alias("momentum"), F.sum("beta_reversal").alias("reversal"))
    return sums.select("year", r6("momentum"), r6("reversal"), r6(F.col("momentum") + F.col("reversal"), "total"))


@query(
    """WITH span AS (SELECT date_trunc('quarter', min(o_orderdate))::DATE AS a, date_trunc('quarter', max(o_orderdate))::DATE AS b FROM orders),
qs AS (SELECT unnest(generate_series(a, b, INTERVAL 3 MONTH))::DATE AS quarter_start FROM span),
n AS (SELECT date_trunc('quarter', o_orderdate)::DATE AS quarter_start, count(*) AS orders, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1)
SELECT quarter_start, (quarter_start + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE AS quarter_end, (quarter_start + (((quarter_start + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE - quarter_start) // 2)::INTEGER)::DATE AS middle, coalesce(orders, 0) AS orders, coalesce(customers, 0) AS customers
FROM qs LEFT JOIN n USING (quarter_start)"""
)
def calendar_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every calendar quarter of the orders' span, with its middle day and what fell into it."""
    o = load(spark, sf_dir, "orders").select(F.trunc("o_orderdate", "quarter").alias("quarter_start"), "o_custkey")
    span = o.agg(F.min("quarter_start").alias("a"), F.max("quarter_start").alias("b"))
    quarters = ts.quarters(span, "a", "b")
    own = o.groupBy("quarter_start").agg(F.count("*").alias("orders"), F.count_distinct("o_custkey").alias("customers"))
    return quarters.join(own, "quarter_start", "left").na.fill(0, ["orders", "customers"])


@query(
    with_views(
        """, l AS (SELECT symbol, max(report_date) AS d FROM statement_facts GROUP BY 1),
n AS (SELECT symbol, field_name, list(field_value ORDER BY report_date DESC)[1:3] AS last FROM statement_facts GROUP BY 1, 2)
SELECT f.symbol, f.report_date, f.field_name, round(f.field_value, 6) AS field_value, round(list_avg(last), 6) AS mean_of_three, (SELECT count(DISTINCT year(report_date)) FROM statement_facts g WHERE g.symbol = f.symbol) AS years
FROM statement_facts f JOIN l ON l.symbol = f.symbol AND l.d = f.report_date JOIN n ON n.symbol = f.symbol AND n.field_name = f.field_name""",
        "statement_facts",
    )
)
def latest_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts of every company's last quarter, the mean of the last three of each field, and the years it has reported in."""
    facts = views.statement_facts(spark, sf_dir)
    ends = facts.groupBy("symbol").agg(F.max("report_date").alias("report_date"), F.count_distinct(F.year("report_date")).alias("years"))
    three = relational.latest_rows(facts, ["symbol", "field_name"], "report_date", 3).groupBy("symbol", "field_name").agg(F.avg("field_value").alias("m"))
    return facts.join(ends, ["symbol", "report_date"]).join(three, ["symbol", "field_name"]).select("symbol", "report_date", "field_name", r6("field_value"), r6("m", "mean_of_three"), "years")


@query(
    with_views(
        """, s AS (SELECT strategy AS series, r FROM strategy_returns UNION ALL SELECT 'benchmark', bench FROM (SELECT DISTINCT month, bench FROM strategy_returns) WHERE bench IS NOT NULL)
SELECT series, count(*) AS n, round(exp(sum(ln(1 + r)) * 12 / count(*)) - 1, 6) AS ann_return, round(stddev_samp(r) * sqrt(12), 6) AS ann_vol, round(avg(r) / stddev_samp(r) * sqrt(12), 6) AS sharpe FROM s GROUP BY 1""",
        "strategy_returns",
    )
)
def risk_return_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return, volatility and ratio of every strategy and of the benchmark."""
    s = views.strategy_returns(spark, sf_dir)
    bench = s.select("month", "bench").distinct().filter("bench IS NOT NULL").select(F.lit("benchmark").alias("series"), F.col("bench").alias("r"))
    m = stats.performance(s.select(F.col("strategy").alias("series"), "r").unionByName(bench), "r", ["series"])
    return m.select("series", "n", r6("ann_return"), r6("ann_vol"), r6("sharpe"))


@query(
    with_views(
        q._FLAGSHIP
        + """SELECT comp.month, count(*) FILTER (composite >= hi) AS longs, count(*) FILTER (composite >= hi AND raw.momentum > 0) AS rising, count(*) FILTER (composite <= lo) AS shorts
FROM comp JOIN cut USING (month) JOIN raw USING (symbol, month) GROUP BY 1""",
        *q._PANEL_VIEWS,
    )
)
def momentum_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of a month's longs rise in themselves; others would be dropped."""
    own = q._returns(spark, sf_dir).select("symbol", "month", F.col("momentum").alias("raw"))
    marked = xs.legs(q._composites(spark, sf_dir), "composite", ["month"]).join(own, ["symbol", "month"]).withColumn("all_longs", F.col("long_core"))
    kept = xs.absolute_momentum(marked, "raw")
    return kept.groupBy("month").agg(F.count_if("all_longs").alias("longs"), F.count_if("long_core").alias("rising"), F.count_if("short_core").alias("shorts"))


@query(
    with_views(
        q._PANEL
        + strategies._CONTEXT
        + "SELECT month, factor, round(ic, 6) AS ic_before FROM rolled",
        *q._PANEL_VIEWS,
        "strategy_returns",
    )
)
def rolling_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each factor's mean rank correlation of the three months before."""
    return strategies._rolled_ics(q._scores(spark, sf_dir)).select("month", "factor", r6("ic", "ic_before"))
