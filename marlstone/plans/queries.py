"""The registered queries of the equity-research operators and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions import scalars
from marlstone.operators import crosssection as xs
from marlstone.operators import portfolio as pf
from marlstone.operators import factors, leaves, quality, ratios, regression, relational, stats, text
from marlstone.operators import timeseries as ts
from marlstone.plans import views
from marlstone.plans.views import with_views
from marlstone.session import checkpointed, shared_folder
from marlstone.sources.tables import as_json, export_rows, load
from marlstone.streaming import events

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def r6(c: str | Column, name: str | None = None) -> Column:
    """Rounded to six places, as the SQL does, so that the order of sums doesn't show; -0 becomes 0."""
    col = F.col(c) if isinstance(c, str) else c
    return (F.round(col, 6) + 0.0).alias(name or c)


# ---------------------------------------------------------------- point in time, as-of, choices


def _calendar(spark: SparkSession, sf_dir: str) -> list:
    """Every fifth day of the facts' span."""
    lo, hi = load(spark, sf_dir, "events").agg(F.min(F.to_date("ts")), F.max(F.to_date("ts"))).first()
    return [] if lo is None else [lo + timedelta(days=i) for i in range(0, (hi - lo).days + 6, 5)]


@query(
    with_views(
        """, cal AS (SELECT unnest(generate_series(min(report_date), max(report_date) + 5, INTERVAL 5 DAY))::DATE AS as_of FROM fundamentals),
last AS (
  SELECT as_of, symbol, field_name, arg_max(field_value, (report_date, event_id)) AS v
  FROM cal JOIN fundamentals ON report_date <= as_of - 2 GROUP BY ALL)
SELECT as_of, symbol, max(v) FILTER (field_name = 'click') AS click, max(v) FILTER (field_name = 'view') AS view,
  max(v) FILTER (field_name = 'purchase') AS purchase, count(*) AS fields FROM last GROUP BY 1, 2""",
        "fundamentals",
    )
)
def pit_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = views.fundamentals(spark, sf_dir)
    held = relational.point_in_time(facts, ["symbol", "field_name"], "report_date", ["event_id"], _calendar(spark, sf_dir), lag_days=2)
    pick = lambda f: F.max(F.when(F.col("field_name") == f, F.col("field_value"))).alias(f)
    return held.groupBy("as_of", "symbol").agg(pick("click"), pick("view"), pick("purchase"), F.count("*").alias("fields"))


@query(
    with_views(
        """SELECT f.event_id, f.symbol, f.report_date, v.close FROM fundamentals f ASOF LEFT JOIN vix v ON f.report_date - 1 >= v.day""",
        "fundamentals",
        "vix",
    )
)
def asof_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = views.fundamentals(spark, sf_dir).withColumn("at", F.date_sub("report_date", 1)).withColumn("part", F.lit(0))
    # one index for all: days of facts are looked up first, so that rows of a day share one lookup
    days = left.select("part", "at").distinct()
    found = relational.asof_join(days, views.vix(spark, sf_dir).withColumn("part", F.lit(0)), ["part"], "at", "day", ["close"])
    return left.join(found, ["part", "at"], "left").select("event_id", "symbol", "report_date", "close")


@query(
    with_views(
        """SELECT d.symbol, d.month, coalesce(
  (SELECT arg_min(px, p.month) FROM prices p WHERE p.symbol = d.symbol AND p.month >= d.month),
  (SELECT arg_max(px, p.month) FROM prices p WHERE p.symbol = d.symbol AND p.month < d.month)) AS px
FROM (SELECT symbol, month FROM panel WHERE px IS NULL) d""",
        "panel",
    )
)
def asof_forward_else_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.prices(spark, sf_dir)
    gaps = ts.month_panel(p).filter("px is null").select("symbol", "month")
    return relational.asof_join(gaps, p, ["symbol"], "month", "month", ["px"], "forward", then_other=True)


@query(
    """SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM (
  SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_linenumber > 1
  UNION ALL SELECT l_orderkey, 1, 100.0 + max(l_suppkey) FROM lineitem GROUP BY 1) GROUP BY 1, 2"""
)
def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load(spark, sf_dir, "lineitem")
    old = li.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"))
    new = li.select("l_orderkey", F.lit(1).alias("l_linenumber"), (100.0 + F.col("l_suppkey")).alias("l_quantity"), F.col("l_suppkey").alias("batch"))
    return relational.upsert(old, new, ["l_orderkey", "l_linenumber"], "batch")


@query(
    with_views(
        """SELECT symbol, month, px FROM prices UNION ALL
SELECT symbol, month, -1.0 FROM panel WHERE px IS NULL""",
        "panel",
    )
)
def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.prices(spark, sf_dir).select("symbol", "month", "px")
    grid = ts.month_panel(p).select("symbol", "month", F.lit(-1.0).alias("px"))
    return relational.insert_absent(p, grid, ["symbol", "month"])


@query(
    with_views(
        """, ranked AS (
  SELECT *, CASE field_name WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS priority FROM fundamentals)
SELECT symbol, event_id, field_name, priority FROM ranked QUALIFY priority = min(priority) OVER (PARTITION BY symbol)""",
        "fundamentals",
    )
)
def source_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = views.fundamentals(spark, sf_dir)
    priority = F.when(F.col("field_name") == "purchase", 1).when(F.col("field_name") == "click", 2).otherwise(3)
    return relational.source_cascade(facts.withColumn("priority", priority), ["symbol"], "priority").select("symbol", "event_id", "field_name", "priority")


@query(
    """SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01')"""
)
def not_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    active, orders = load(spark, sf_dir, "customer").select("c_custkey"), load(spark, sf_dir, "orders")
    covered = orders.filter(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp")).select(F.col("o_custkey").alias("c_custkey"))
    return relational.not_covered(active, covered, "c_custkey")


@query(
    with_views(
        """SELECT symbol, ordinal, title FROM news QUALIFY trim(title, ' ') = '' OR row_number() OVER (PARTITION BY symbol, lower(trim(title, ' ')) ORDER BY ordinal) = 1""",
        "news",
    )
)
def dedupe_headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.dedupe_titles(views.news(spark, sf_dir), "title", ["ordinal"], ["symbol"])


@query(
    with_views(
        """SELECT s.symbol, s.country, coalesce(arg_max(f.field_name, (f.report_date, f.event_id)), 'USD') AS currency
FROM universe s LEFT JOIN fundamentals f ON s.symbol = f.symbol GROUP BY 1, 2""",
        "universe",
        "fundamentals",
    )
)
def latest_attribute_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = views.universe(spark, sf_dir)
    last = relational.latest_per_key(views.fundamentals(spark, sf_dir), ["symbol"], ["report_date", "event_id"]).select("symbol", "field_name")
    return u.join(last, "symbol", "left").select("symbol", "country", F.coalesce("field_name", F.lit("USD")).alias("currency"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)""")
def orphan_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = load(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select(F.col("s_suppkey").alias("l_suppkey"))
    return load(spark, sf_dir, "lineitem").join(keep, "l_suppkey", "left_semi").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


# ---------------------------------------------------------------- scalars, exports, quality


@query(
    """SELECT p_partkey, trim(p_brand) || '.' || CASE WHEN p_size % 4 = 0 THEN 'L' WHEN p_size % 4 = 1 THEN 'S' WHEN p_size % 4 = 2 THEN 'B' ELSE 'PA' END AS symbol,
  CASE WHEN p_size % 4 = 1 THEN trim(p_brand) || '.SW' WHEN p_size % 4 = 2 THEN trim(p_brand) || '-B' WHEN p_size % 4 = 0 THEN trim(p_brand) || '.L' ELSE trim(p_brand) || '.PA' END AS feed_symbol,
  CASE WHEN p_size % 4 = 0 THEN 'GBP' WHEN p_size % 4 = 1 THEN 'CHF' WHEN p_size % 4 = 2 THEN 'USD' ELSE 'EUR' END AS currency,
  CASE WHEN p_size % 4 = 0 THEN 'GBPUSD=X' WHEN p_size % 4 = 1 THEN 'CHFUSD=X' WHEN p_size % 4 = 2 THEN NULL ELSE 'EURUSD=X' END AS pair
FROM part"""
)
def ticker_preparation(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part")
    size = F.col("p_size") % 4
    end = F.when(size == 0, "L").when(size == 1, "S").when(size == 2, "B").otherwise("PA")
    raw = p.select("p_partkey", scalars.feed_symbol(F.concat(F.lit("  "), F.trim("p_brand"), F.lit("."), end)).alias("t"))
    return raw.select("p_partkey", "t.*", scalars.fx_pair(F.col("t.currency")).alias("pair"))


@query(
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE (props->>'$.k')::DOUBLE END AS k_float, CASE WHEN event_id % 3 = 0 THEN NULL ELSE trunc((props->>'$.k')::DOUBLE)::BIGINT END AS k_int FROM events"""
)
def safe_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))
    dirty = F.when(F.col("event_id") % 3 == 0, F.when(F.col("event_id") % 2 == 0, ".").otherwise("NaN")).otherwise(F.col("k"))
    return e.select("event_id", scalars.safe_float(dirty).alias("k_float"), scalars.safe_int(dirty).alias("k_int"))


@query(
    with_views(
        """SELECT count(*) AS "rows", count(DISTINCT symbol) AS keys, min(report_date) AS "first", max(report_date) AS "last",
  round(count(field_value) / count(*) * 100, 1) AS pct_field_value FROM fundamentals""",
        "fundamentals",
    )
)
def table_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.table_summary(views.fundamentals(spark, sf_dir), "symbol", "report_date", ["field_value"])


@query(
    with_views(
        """SELECT field_name, count(*) AS "rows", count(field_value) AS non_null, round(count(field_value) / count(*) * 100, 1) AS pct_non_null,
  count(DISTINCT symbol) AS keys, round(count(DISTINCT symbol) / (SELECT count(DISTINCT symbol) FROM fundamentals) * 100, 1) AS pct_keys,
  min(report_date) AS "first", max(report_date) AS "last" FROM fundamentals GROUP BY 1""",
        "fundamentals",
    )
)
def field_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.field_breakdown(views.fundamentals(spark, sf_dir), "field_name", "field_value", "symbol", "report_date")


@query(with_views("SELECT symbol, count(DISTINCT report_date) AS dates FROM fundamentals GROUP BY 1 HAVING count(DISTINCT report_date) >= 20", "fundamentals"))
def deep_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.deep_coverage(views.fundamentals(spark, sf_dir), "symbol", "report_date", 20)


@query(
    """SELECT count(*) AS "rows", count(*) FILTER (l_extendedprice IS NULL) AS null_close, count(*) FILTER (l_tax < l_discount) AS high_below_low,
  count(*) FILTER (l_quantity < 0) AS negative_volume FROM lineitem"""
)
def price_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.price_quality(load(spark, sf_dir, "lineitem"), "l_extendedprice", "l_tax", "l_discount", "l_quantity")


@query("SELECT l_orderkey, l_linenumber, greatest(l_tax, l_discount) AS l_tax, least(l_tax, l_discount) AS l_discount FROM lineitem")
def high_low_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.swapped_high_low(load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_tax", "l_discount"), "l_tax", "l_discount")


@query(
    """SELECT event_type, count(*) AS events, count(*) FILTER (value > 50) AS good, round(count(*) FILTER (value > 50) / count(*) * 100, 1) AS pct_good FROM events GROUP BY 1"""
)
def success_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = load(spark, sf_dir, "events").withColumn("status", F.when(F.col("value") > 50, "success").otherwise("failed"))
    return quality.success_rates(log, "status", ["event_type"], ["success"])


@query()
def content_print(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.content_print(views.prices(spark, sf_dir), ["symbol", "month", "px"])


@query(with_views("SELECT symbol, month, px, volume FROM prices WHERE symbol = 7 AND month BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'", "prices"))
def export_by_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export_rows(views.prices(spark, sf_dir), "symbol", "7", "month", "1996-01-01", "1997-12-31")


@query("""SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' AS value FROM nation""")
def export_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_json(load(spark, sf_dir, "nation").select("n_nationkey", "n_name"))


@query("SELECT date_trunc('month', l_shipdate)::DATE AS month, max(l_shipdate)::DATE AS session FROM lineitem GROUP BY 1")
def month_end_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load(spark, sf_dir, "lineitem")
    return li.groupBy(F.trunc("l_shipdate", "MM").alias("month")).agg(F.to_date(F.max("l_shipdate")).alias("session"))


@query(
    """WITH adv AS (SELECT l_partkey AS symbol, avg(l_extendedprice) AS adv FROM lineitem GROUP BY 1)
SELECT symbol, round(adv, 6) AS adv FROM adv WHERE adv >= greatest(30000, (SELECT quantile_cont(adv, 0.15) FROM adv))"""
)
def liquidity_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    adv = load(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("symbol")).agg(F.avg("l_extendedprice").alias("adv"))
    return quality.liquidity_filter(adv, "adv", 30000.0).select("symbol", r6("adv"))


# ---------------------------------------------------------------- series


def _returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel with returns and momentum."""
    panel = ts.changes(ts.padded_panel(views.prices(spark, sf_dir), "px"), "px", ["symbol"], "month")
    return ts.momentum(panel, "px", ["symbol"], "month")


@query(with_views("SELECT symbol, month, row, round(ret, 6) AS ret, round(momentum, 6) AS momentum FROM returns", "returns"))
def returns_and_momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _returns(spark, sf_dir).select("symbol", "month", "row", r6("ret"), r6("momentum"))


@query(
    with_views(
        """, fxr AS (SELECT sector, month, fx / lag(fx) OVER (PARTITION BY sector ORDER BY month) - 1 AS fx_ret FROM fx)
SELECT r.symbol, r.month, round((1 + ret) * (1 + coalesce(fx_ret, 0)) - 1, 6) AS usd_ret
FROM returns r JOIN universe u USING (symbol) LEFT JOIN fxr ON fxr.sector = u.sector AND fxr.month = r.month""",
        "returns",
        "universe",
        "fx",
    )
)
def usd_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    change = F.try_divide(F.col("fx"), F.lag("fx").over(Window.partitionBy("sector").orderBy("month"))) - 1
    rates = views.fx(spark, sf_dir).select("sector", "month", change.alias("fx_ret"))
    own = _returns(spark, sf_dir).join(views.universe(spark, sf_dir), "symbol").join(rates, ["sector", "month"], "left")
    return ts.usd_returns(own, "ret", "fx_ret").select("symbol", "month", r6("usd_ret"))


_NAV = """, nav AS (SELECT *, exp(sum(ln(1 + r)) OVER (PARTITION BY strategy ORDER BY month)) AS nav FROM strategy_returns),
dd AS (SELECT *, nav / max(nav) OVER (PARTITION BY strategy ORDER BY month) - 1 AS drawdown FROM nav)
"""


@query(with_views(_NAV + "SELECT strategy, month, round(nav, 6) AS nav, round(drawdown, 6) AS drawdown FROM dd", "strategy_returns"))
def drawdown_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ts.drawdowns(views.strategy_returns(spark, sf_dir), "r", ["strategy"], "month").select("strategy", "month", r6("nav"), r6("drawdown"))


@query(
    with_views(
        _NAV
        + """, t AS (SELECT strategy, min(drawdown) AS m, arg_min(month, drawdown) AS trough, max(month) AS e FROM dd GROUP BY 1)
SELECT strategy, round(any_value(m), 6) AS max_drawdown, trough,
  datediff('month', trough, coalesce(min(dd.month) FILTER (dd.month > trough AND drawdown >= -1e-8), any_value(e)))::INTEGER AS duration_months
FROM t JOIN dd USING (strategy) GROUP BY strategy, trough""",
        "strategy_returns",
    )
)
def drawdown_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ts.drawdown_durations(views.strategy_returns(spark, sf_dir), "r", ["strategy"], "month").select("strategy", r6("max_drawdown"), "trough", "duration_months")


@query(
    with_views(
        """SELECT strategy, month, CASE WHEN count(*) OVER w >= 12 THEN round(avg(r) OVER w, 9) END AS roll_mean,
  CASE WHEN count(*) OVER w >= 12 THEN round(avg(r) OVER w * 12 / (stddev_samp(r) OVER w * sqrt(12)), 6) END AS roll_sharpe
FROM strategy_returns WINDOW w AS (PARTITION BY strategy ORDER BY month ROWS 11 PRECEDING)""",
        "strategy_returns",
    )
)
def rolling_sharpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ts.rolling(views.strategy_returns(spark, sf_dir), "r", ["strategy"], "month", 12).select("strategy", "month", F.round("roll_mean", 9).alias("roll_mean"), r6("roll_sharpe"))


_REGIME = """, seen AS (
  SELECT a.day, a.close, count(*) AS n, count(*) FILTER (b.close < a.close) AS under, count(*) FILTER (b.close = a.close) AS same
  FROM vix a JOIN vix b ON b.day <= a.day GROUP BY 1, 2),
regime AS (
  SELECT day, close, CASE WHEN n >= 20 THEN (under + (same + 1) / 2) / n ELSE 0.5 END AS percentile,
    CASE WHEN n < 20 THEN 'NORMAL' WHEN (under + (same + 1) / 2) / n < 0.3 THEN 'LOW' WHEN (under + (same + 1) / 2) / n > 0.8 THEN 'HIGH' ELSE 'NORMAL' END AS regime
  FROM seen)
"""


@query(with_views(_REGIME + "SELECT day, close, round(percentile, 6) AS percentile, regime FROM regime", "vix"))
def vix_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ts.regimes(views.vix(spark, sf_dir), "close", "day").select("day", "close", r6("percentile"), "regime")


@query(
    with_views(
        _REGIME
        + """, c AS (SELECT *, CASE WHEN regime IS DISTINCT FROM lag(regime) OVER (ORDER BY day) THEN 1 ELSE 0 END AS c FROM regime),
g AS (SELECT *, sum(c) OVER (ORDER BY day) AS g FROM c)
SELECT regime, min(day) AS "start", max(day) AS "end", count(*) AS "rows" FROM g GROUP BY g, regime""",
        "vix",
    )
)
def regime_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ts.islands(ts.regimes(views.vix(spark, sf_dir), "close", "day").withColumn("part", F.lit(0)), "regime", ["part"], "day").drop("part")


@query(
    with_views(
        """, q AS (SELECT symbol, field_name, report_date, arg_max(field_value, event_id) AS v FROM fundamentals GROUP BY 1, 2, 3),
p AS (SELECT *, lag(v) OVER (PARTITION BY symbol, field_name ORDER BY report_date) AS prev FROM q)
SELECT symbol, field_name, report_date, CASE WHEN abs(prev) > 0.001 AND abs((v - prev) / nullif(abs(prev), 0)) < 100 THEN round((v - prev) / nullif(abs(prev), 0), 6) END AS growth FROM p""",
        "fundamentals",
    )
)
def period_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = relational.latest_per_key(views.fundamentals(spark, sf_dir), ["symbol", "field_name", "report_date"], ["event_id"])
    return ts.growth(last, "field_value", ["symbol", "field_name"], "report_date").select("symbol", "field_name", "report_date", r6("growth"))


@query(
    with_views(
        """SELECT strategy, month, CASE WHEN count(*) OVER w > 10 THEN round((r - avg(r) OVER w) / greatest(stddev_samp(r) OVER w, 1e-6), 6) END AS z
FROM strategy_returns WINDOW w AS (PARTITION BY strategy ORDER BY month ROWS 23 PRECEDING)""",
        "strategy_returns",
    )
)
def trailing_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ts.trailing_z(views.strategy_returns(spark, sf_dir), "r", ["strategy"], "month", rows=24).select("strategy", "month", r6("z"))


@query(
    with_views(
        """SELECT symbol, month, round((rank() OVER (PARTITION BY month ORDER BY volume) + (count(*) OVER (PARTITION BY month, volume) - 1) / 2) / count(*) OVER (PARTITION BY month), 6) AS pct FROM prices""",
        "prices",
    )
)
def rank_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.prices(spark, sf_dir).withColumn("pct", ts.rank_pct("volume", ["month"])).select("symbol", "month", r6("pct"))


# ---------------------------------------------------------------- cross-sections


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("symbol"), F.col("p_brand").alias("sector"), F.col("p_retailprice").alias("a"), F.col("p_size").cast("double").alias("b"), (F.col("p_retailprice") * (F.col("p_partkey") % 13)).alias("c"))


_PARTS = "SELECT p_partkey AS symbol, p_brand AS sector, p_retailprice AS a, p_size::DOUBLE AS b, p_retailprice * (p_partkey % 13) AS c FROM part"
_Z = f"""WITH parts AS ({_PARTS}), q AS (
  SELECT sector, {", ".join(f"quantile_cont({f}, 0.025) AS {f}l, quantile_cont({f}, 0.975) AS {f}h" for f in "abc")} FROM parts GROUP BY 1),
w AS (SELECT symbol, sector, {", ".join(f"least(greatest({f}, {f}l), {f}h) AS {f}" for f in "abc")} FROM parts JOIN q USING (sector)),
z AS (SELECT symbol, sector, {", ".join(f"CASE WHEN count({f}) OVER s < 5 OR stddev_pop({f}) OVER s = 0 THEN 0 ELSE ({f} - avg({f}) OVER s) / stddev_pop({f}) OVER s END AS {f}" for f in "abc")} FROM w WINDOW s AS (PARTITION BY sector))
"""


@query(_Z + "SELECT symbol, sector, round(a, 6) AS a, round(b, 6) AS b, round(c, 6) AS c FROM z")
def sector_neutral_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = xs.zscored(xs.winsorised(_parts(spark, sf_dir), ["a", "b", "c"], ["sector"]), ["a", "b", "c"], ["sector"])
    return z.select("symbol", "sector", r6("a"), r6("b"), r6("c"))


@query(
    _Z
    + """, r1 AS (SELECT *, b - coalesce(sum(a * b) OVER s / nullif(sum(a * a) OVER s, 0), 0) * a AS rb FROM z WINDOW s AS (PARTITION BY sector)),
r2 AS (SELECT *, c - coalesce(sum(a * c) OVER s / nullif(sum(a * a) OVER s, 0), 0) * a - coalesce(sum(rb * c) OVER s / nullif(sum(rb * rb) OVER s, 0), 0) * rb AS rc FROM r1 WINDOW s AS (PARTITION BY sector))
SELECT symbol, sector, round(a, 6) AS a, round(rb, 6) AS b, round(rc, 6) AS c FROM r2"""
)
def residualised_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = xs.zscored(xs.winsorised(_parts(spark, sf_dir), ["a", "b", "c"], ["sector"]), ["a", "b", "c"], ["sector"])
    return xs.residualised(z, ["a", "b", "c"], ["sector"]).select("symbol", "sector", r6("a"), r6("b"), r6("c"))


@query(
    with_views(
        """, fwd AS (SELECT symbol, month, momentum, ret AS reversal, lead(ret) OVER (PARTITION BY symbol ORDER BY month) AS y FROM returns),
long AS (SELECT month, 'momentum' AS factor, momentum AS x, y FROM fwd UNION ALL SELECT month, 'reversal', reversal, y FROM fwd),
ok AS (SELECT * FROM long WHERE x IS NOT NULL AND y IS NOT NULL),
r AS (SELECT *, rank() OVER (PARTITION BY month, factor ORDER BY x) + (count(*) OVER (PARTITION BY month, factor, x) - 1) / 2 AS rx,
  rank() OVER (PARTITION BY month, factor ORDER BY y) + (count(*) OVER (PARTITION BY month, factor, y) - 1) / 2 AS ry FROM ok)
SELECT month, factor, CASE WHEN count(*) >= 5 THEN round(corr(rx, ry), 6) END AS ic_spearman, CASE WHEN count(*) >= 5 THEN round(corr(x, y), 6) END AS ic_pearson, count(*) AS n
FROM r GROUP BY 1, 2""",
        "returns",
    )
)
def information_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _forward(spark, sf_dir)
    return xs.information_coefficient(own, ["momentum", "reversal"], "y", ["month"]).select("month", "factor", r6("ic_spearman"), r6("ic_pearson"), "n")


def _forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("month")
    return _returns(spark, sf_dir).select("symbol", "month", "momentum", F.col("ret").alias("reversal"), F.lead("ret").over(w).alias("y"))


@query(
    with_views(
        """, q AS (SELECT month, quantile_cont(momentum, 0.25) AS lo, quantile_cont(momentum, 0.75) AS hi FROM returns GROUP BY 1)
SELECT month, CASE WHEN count(momentum) >= 10 THEN round(avg(momentum) FILTER (momentum >= hi) - avg(momentum) FILTER (momentum <= lo), 6) ELSE 0 END AS momentum
FROM returns JOIN q USING (month) GROUP BY 1""",
        "returns",
    )
)
def factor_dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return xs.dispersion(_returns(spark, sf_dir), ["momentum"], ["month"]).select("month", r6("momentum"))


@query(
    with_views(
        """, ok AS (SELECT month, momentum AS a, reversal AS b, y FROM (
    SELECT symbol, month, momentum, ret AS reversal, lead(ret) OVER (PARTITION BY symbol ORDER BY month) AS y FROM returns)
  WHERE momentum IS NOT NULL AND reversal IS NOT NULL AND y IS NOT NULL),
s AS (SELECT month, count(*) AS n, sum(a*a) aa, sum(a*b) ab, sum(b*b) bb, sum(a*y) ay, sum(b*y) b_y FROM ok GROUP BY 1 HAVING count(*) >= 10),
beta AS (SELECT (bb * ay - ab * b_y) / (aa * bb - ab * ab) AS m, (aa * b_y - ab * ay) / (aa * bb - ab * ab) AS r FROM s)
SELECT 'beta_momentum' AS factor, round(avg(m), 6) AS mean, round(avg(m) / (stddev_samp(m) / sqrt(count(*))), 6) AS t_stat, count(*) AS n FROM beta
UNION ALL SELECT 'beta_reversal', round(avg(r), 6), round(avg(r) / (stddev_samp(r) / sqrt(count(*))), 6), count(*) FROM beta""",
        "returns",
    )
)
def fama_macbeth(spark: SparkSession, sf_dir: str) -> DataFrame:
    betas = regression.cross_section_fit(_forward(spark, sf_dir), ["momentum", "reversal"], "y", ["month"])
    return stats.t_statistics(betas, ["beta_momentum", "beta_reversal"]).select("factor", r6("mean"), r6("t_stat"), "n")


_WEIGHTS = {"momentum": 0.30, "value": 0.30, "quality": 0.25, "sentiment": 0.15}
_FOUR = list(_WEIGHTS)


def _pivot_sql(fields: Sequence[str]) -> str:
    return ", ".join(f"max(v) FILTER (field_name = '{f}') AS {f}" for f in fields)


def _first_sql(*candidates: str) -> str:
    """The first candidate that has a value anywhere in the month, for all of it."""
    return "CASE " + " ".join(f"WHEN count({c}) OVER m > 0 THEN {c}" for c in candidates) + " END"


def _each(template: str, by: Sequence[str] = tuple(_FOUR)) -> str:
    return ", ".join(template.replace("@", f) for f in by)


#: Scores known at each month's start, their z values by month and sector (z), and forward returns (fwd).
_PANEL = f""", cal AS (SELECT DISTINCT month FROM returns),
rp AS (SELECT month, symbol, field_name, arg_max(field_value, snapshot_date) AS v FROM cal JOIN ratio_facts ON snapshot_date <= month - 45 GROUP BY ALL),
rw AS (SELECT month, symbol, {_pivot_sql(factors.RATIO_FIELDS)} FROM rp GROUP BY 1, 2),
fp AS (SELECT month, symbol, field_name, arg_max(field_value, report_date) AS v FROM cal JOIN statement_facts ON report_date <= month - 45 GROUP BY ALL),
fw AS (SELECT month, symbol, {_pivot_sql(factors.STATEMENT_FIELDS)} FROM fp GROUP BY 1, 2),
mood AS (SELECT month, symbol, arg_max(score, day) AS sentiment FROM cal JOIN sentiment_facts ON day <= month GROUP BY 1, 2),
picked AS (
  SELECT symbol, month, sector, momentum, ret, sentiment,
    {_first_sql("book_to_price_hist", "book_to_price", "(book_value_per_share / nullif(px, 0))")} AS v1,
    {_first_sql("earnings_to_price_hist", "earnings_to_price", "(diluted_eps / nullif(px, 0))")} AS v2,
    {_first_sql("cashflow_to_price_hist", "cashflow_to_price", "(free_cash_flow / nullif(px, 0))")} AS v3,
    {_first_sql("roe_hist", "roe_computed", "return_on_equity", "(net_income / nullif(stockholders_equity, 0))")} AS q1,
    {_first_sql("profit_margin_hist", "operating_margin_hist", "earnings_stability", "(net_income / nullif(total_revenue, 0))")} AS q2,
    {_first_sql("(1 / (abs(debt_to_equity_hist) + 0.1))", "debt_to_equity_inv", "(1 / (abs(total_debt) / nullif(abs(stockholders_equity), 0) + 0.1))")} AS q3
  FROM returns JOIN universe USING (symbol) LEFT JOIN rw USING (symbol, month) LEFT JOIN fw USING (symbol, month) LEFT JOIN mood USING (symbol, month)
  WINDOW m AS (PARTITION BY month)),
raw AS (SELECT symbol, month, sector, momentum, list_avg([v1, v2, v3]) AS value, list_avg([q1, q2, q3]) AS quality, sentiment FROM picked),
ok AS (SELECT * FROM raw WHERE momentum IS NOT NULL),
q AS (SELECT month, sector, {_each("quantile_cont(@, 0.025) AS @_l, quantile_cont(@, 0.975) AS @_h")} FROM ok GROUP BY 1, 2),
w AS (SELECT symbol, month, sector, {_each("CASE WHEN @ IS NOT NULL THEN least(greatest(@, @_l), @_h) END AS @")} FROM ok JOIN q USING (month, sector)),
z AS (SELECT symbol, month, sector,
  {_each("CASE WHEN @ IS NULL THEN NULL WHEN count(@) OVER s < 5 OR stddev_pop(@) OVER s = 0 THEN 0 ELSE (@ - avg(@) OVER s) / stddev_pop(@) OVER s END AS @")}
  FROM w WINDOW s AS (PARTITION BY month, sector)),
fwd AS (SELECT symbol, month, lead(ret) OVER (PARTITION BY symbol ORDER BY month) AS y FROM returns),
held AS (SELECT month, {_each("count(@) AS c_@")} FROM z GROUP BY 1)"""

_FLAGSHIP = (
    _PANEL
    + f""",
cov AS (SELECT month, {" + ".join(f"(c_{f} = 0)::INTEGER * {w}::DOUBLE" for f, w in _WEIGHTS.items())} AS missing FROM held),
comp AS (SELECT symbol, month, sector, round(({" + ".join(f"{w}::DOUBLE * coalesce({f}, 0)" for f, w in _WEIGHTS.items())}) * CASE WHEN missing > 0 AND missing < 0.999 THEN 1 / (1 - missing) ELSE 1 END, 9) AS composite FROM z JOIN cov USING (month)),
cut AS (SELECT month, quantile_cont(composite, 0.2) AS lo, quantile_cont(composite, 0.8) AS hi FROM comp GROUP BY 1),
leg AS (SELECT symbol, month, composite, CASE WHEN composite >= hi THEN 1 WHEN composite <= lo THEN -1 END AS side FROM comp JOIN cut USING (month)),
mid AS (SELECT *, median(composite) OVER (PARTITION BY month, side) AS m FROM leg WHERE side IS NOT NULL),
up AS (SELECT *, greatest(side * (composite - m), 0) AS u FROM mid),
book AS (SELECT symbol, month, side, CASE WHEN sum(u) OVER x > 0 THEN u / sum(u) OVER x ELSE 1.0 / count(*) OVER x END * 0.5 * side AS weight FROM up WINDOW x AS (PARTITION BY month, side)),
num AS (SELECT DISTINCT month, (year(month) * 12 + month(month))::INTEGER AS k FROM book),
nb AS (SELECT k, symbol, weight FROM book JOIN num USING (month)),
mx AS (SELECT max(k) AS m FROM nb),
turn AS (SELECT coalesce(a.k, b.k + 1) AS k, sum(abs(coalesce(a.weight, 0) - coalesce(b.weight, 0))) / 2 AS turnover
  FROM nb a FULL JOIN nb b ON a.k = b.k + 1 AND a.symbol = b.symbol GROUP BY 1)
"""
)
_PANEL_VIEWS = ("returns", "universe", "ratio_facts", "statement_facts", "sentiment_facts")


def _paid() -> Column:
    """What a book earns; a missing return counts as 0."""
    return F.sum(F.col("weight") * F.coalesce("y", F.lit(0.0))).alias("port_ret")


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, month, sectors, px, momentum, y, sentiment and what value and quality are made of), every symbol in every month, written once; no sectors beyond the universe."""
    sectors = views.universe(spark, sf_dir).groupBy("symbol").agg(F.collect_list("sector").alias("sectors"))
    known = views.known_months(checkpointed(views.quarterly_sums(spark, sf_dir)).join(sectors, "symbol", "left"), keep=["sectors"])
    change = {"momentum": F.try_divide("before", "year_ago") - 1, "y": F.try_divide("ahead", "px") - 1}
    return checkpointed(known.withColumns(change).drop("before", "year_ago", "ahead"))


def _scores(spark: SparkSession, sf_dir: str, panel: DataFrame | None = None) -> DataFrame:
    """(symbol, month, sector, y, momentum, value, quality, sentiment): z values by month and sector of what was known then, and the next month's return."""
    panel = _panel(spark, sf_dir) if panel is None else panel
    listed = panel.withColumn("sector", F.explode("sectors")).drop("sectors")
    raw = factors.scored(listed).filter("momentum is not null").select("symbol", "month", "sector", "y", *_FOUR)
    return xs.zscored(xs.winsorised(raw, _FOUR, ["month", "sector"]), _FOUR, ["month", "sector"]).select("symbol", "month", "sector", "y", *_FOUR)


def _composites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return xs.composite(_scores(spark, sf_dir), _WEIGHTS, ["month"]).withColumn("composite", F.round("composite", 9))


def _book(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    side = F.when(F.col("long_core"), 1).when(F.col("short_core"), -1)
    marked = xs.legs(_composites(spark, sf_dir), "composite", ["month"]).withColumn("side", side)
    book = pf.score_weights(marked, "composite", "side", ["month"])
    # months have no gaps, so they can be numbered by the calendar
    return book.select("symbol", "month", (F.year("month") * 12 + F.month("month")).alias("k"), "sector", "composite", "weight", *more)


@query(with_views(_FLAGSHIP + "SELECT symbol, month, round(weight, 6) AS weight FROM book", *_PANEL_VIEWS))
def factor_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _book(spark, sf_dir).select("symbol", "month", r6("weight"))


@query(
    with_views(
        _FLAGSHIP
        + """, port AS (SELECT b.month, sum(weight * coalesce(y, 0)) AS gross_ret FROM book b LEFT JOIN fwd USING (symbol, month) GROUP BY 1)
SELECT p.month, round(gross_ret, 6) AS gross_ret, round(turnover, 6) AS turnover, round(gross_ret - turnover * 2 * 20 / 1e4, 6) AS net_ret
FROM port p JOIN num USING (month) JOIN turn USING (k)""",
        *_PANEL_VIEWS,
    )
)
def factor_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices to net monthly returns: scores, legs, weights, next month's return, turnover and costs."""
    book = checkpointed(_book(spark, sf_dir, "y"))
    gross = book.groupBy("month", "k").agg(_paid())
    changes = pf.book_changes(book, "weight", [], "symbol", "k")
    both = gross.join(pf.turnover(changes, ["k"]), "k")
    net = F.col("port_ret") - pf.cost_drag(F.col("turnover"), 20)
    return both.select("month", r6("port_ret", "gross_ret"), r6("turnover"), r6(net, "net_ret"))


@query(
    with_views(
        _FLAGSHIP
        + """SELECT month, round(sum(abs(weight)), 6) AS gross, round(sum(weight), 6) + 0.0 AS net, round(sum(weight * weight), 6) AS hhi,
  count(*) FILTER (weight > 0) AS n_long, count(*) FILTER (weight < 0) AS n_short FROM book GROUP BY 1""",
        *_PANEL_VIEWS,
    )
)
def exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = pf.exposures(_book(spark, sf_dir), "weight", ["month"])
    return e.select("month", r6("gross"), r6("net"), r6("hhi"), "n_long", "n_short")


@query(
    with_views(
        _FLAGSHIP
        + """, led AS (SELECT coalesce(a.k, b.k + 1) AS k, coalesce(a.symbol, b.symbol) AS symbol, coalesce(a.weight, 0) AS n, coalesce(b.weight, 0) AS o
  FROM nb a FULL JOIN nb b ON a.k = b.k + 1 AND a.symbol = b.symbol)
SELECT k, symbol, CASE WHEN o = 0 THEN 'open' WHEN n = 0 THEN 'close' ELSE 'adjust' END AS action, CASE WHEN n > o THEN 'buy' ELSE 'sell' END AS side,
  round(abs(n - o) * 1e6, 2) AS notional, round(5 * sqrt(abs(n - o)), 6) AS impact_bp FROM led, mx WHERE abs(n - o) > 1e-12 AND k <= m""",
        *_PANEL_VIEWS,
    )
)
def trade_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = load(spark, sf_dir, "lineitem").agg(F.max(F.year("l_shipdate") * 12 + F.month("l_shipdate"))).first()[0] or 0
    changes = pf.book_changes(_book(spark, sf_dir), "weight", [], "symbol", "k").filter(F.col("k") <= last)
    return pf.trade_ledger(changes, ["k", "symbol"]).select("k", "symbol", "action", "side", F.round("notional", 2).alias("notional"), r6("impact_bp"))


@query(
    with_views(
        _FLAGSHIP
        + """, own AS (SELECT month, sector, sum(abs(weight)) AS sector_weight FROM book JOIN universe USING (symbol) GROUP BY 1, 2)
SELECT month, sector, round(sector_weight, 6) AS sector_weight, round(sector_weight - 1.0 / count(*) OVER (PARTITION BY month), 6) AS allocation FROM own""",
        *_PANEL_VIEWS,
    )
)
def sector_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _book(spark, sf_dir).withColumn("weight", F.abs("weight"))
    return stats.sector_attribution(own, "weight", "sector", ["month"]).select("month", "sector", r6("sector_weight"), r6("allocation"))


@query(
    with_views(
        _FLAGSHIP
        + """, pts AS (SELECT month, quantile_cont(composite, 0.2) AS sc, quantile_cont(composite, 0.25) AS sb, quantile_cont(composite, 0.75) AS lb, quantile_cont(composite, 0.8) AS lc FROM comp GROUP BY 1),
m AS (SELECT symbol, month, datediff('month', DATE '1990-01-01', month) AS i, composite >= lc AS core, composite >= lb AS band FROM comp JOIN pts USING (month)),
b AS (SELECT *, CASE WHEN NOT band OR lag(band) OVER w IS NOT TRUE OR lag(i) OVER w <> i - 1 THEN 1 ELSE 0 END AS br FROM m WINDOW w AS (PARTITION BY symbol ORDER BY i)),
g AS (SELECT *, sum(br) OVER (PARTITION BY symbol ORDER BY i) AS run FROM b)
SELECT symbol, month, band AND max(core::INTEGER) OVER (PARTITION BY symbol, run ORDER BY i) = 1 AS member FROM g""",
        *_PANEL_VIEWS,
    )
)
def leg_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = xs.legs(_composites(spark, sf_dir), "composite", ["month"]).withColumn("i", F.year("month") * 12 + F.month("month"))
    return xs.held_members(marked, "long_core", "long_band", ["symbol"], "i", "member").select("symbol", "month", "member")


@query()
def capped_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = _book(spark, sf_dir).filter("weight > 0").select("symbol", "month", "weight")
    return pf.capped(long, "weight", ["month"], 0.05).select("symbol", "month", r6("weight"))


# ---------------------------------------------------------------- statistics


@query(
    with_views(
        """SELECT strategy, count(*) AS n, round(exp(sum(ln(1 + r)) * 12 / count(*)) - 1, 6) AS ann_return, round(stddev_samp(r) * sqrt(12), 6) AS ann_vol,
  round(avg(r) / stddev_samp(r) * sqrt(12), 6) AS sharpe, round(avg(r) * sqrt(12) / stddev_samp(r) FILTER (r < 0), 6) AS sortino,
  round((avg(r*r*r) - 3 * avg(r) * avg(r*r) + 2 * pow(avg(r), 3)) / pow(stddev_pop(r), 3), 6) AS skew, round(kurtosis_pop(r), 6) AS excess_kurtosis,
  round(avg((r > 0)::DOUBLE), 6) AS hit_rate, round(avg((r < 0)::DOUBLE), 6) AS pct_negative, max(r) AS best, min(r) AS worst, round(sqrt(avg(pow(least(r, 0), 2))) * sqrt(12), 6) AS downside_dev
FROM strategy_returns GROUP BY 1""",
        "strategy_returns",
    )
)
def headline_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = stats.performance(views.strategy_returns(spark, sf_dir), "r", ["strategy"])
    return m.select("strategy", "n", *[r6(c) for c in m.columns[2:]])


@query(
    with_views(
        """SELECT strategy, round(avg(r - bench) * 12, 6) AS active_return, round(stddev_samp(r - bench) * sqrt(12), 6) AS tracking_error,
  round(avg(r - bench) * 12 / (stddev_samp(r - bench) * sqrt(12)), 6) AS information_ratio, round(covar_samp(r, bench) / var_samp(bench), 6) AS beta
FROM strategy_returns GROUP BY 1""",
        "strategy_returns",
    )
)
def benchmark_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = stats.versus_benchmark(views.strategy_returns(spark, sf_dir), "r", "bench", ["strategy"])
    return m.select("strategy", *[r6(c) for c in m.columns[1:]])


@query(
    with_views(
        """, q AS (SELECT strategy, quantile_cont(r, 0.05) AS q, count(*) AS n FROM strategy_returns GROUP BY 1)
SELECT strategy, n, round(-any_value(q), 6) AS var, round(-avg(r) FILTER (r <= q), 6) AS es FROM strategy_returns JOIN q USING (strategy) GROUP BY 1, 2""",
        "strategy_returns",
    )
)
def tail_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pf.tail_risk(views.strategy_returns(spark, sf_dir), "r", ["strategy"], confidence=0.95).select("strategy", "n", r6("var"), r6("es"))


@query(
    with_views(
        """, rows AS (SELECT strategy, r, row_number() OVER (PARTITION BY strategy ORDER BY month) - 1 AS i FROM strategy_returns),
n AS (SELECT strategy, count(*) AS n FROM rows GROUP BY 1),
d AS (SELECT strategy, p.path, (('0x' || md5(concat_ws('-', p.path, k.k // 6, 42))[1:12])::BIGINT % n + k.k % 6) % n AS i FROM n, (SELECT unnest(range(2000)) AS path) p, (SELECT unnest(range((SELECT max(n) FROM n))) AS k) k WHERE k.k < n),
s AS (SELECT strategy, path, avg(r) / stddev_samp(r) * sqrt(12) AS s FROM d JOIN rows USING (strategy, i) GROUP BY 1, 2)
SELECT strategy, round(avg(s), 6) AS mean, round(quantile_cont(s, 0.025), 6) AS low, round(quantile_cont(s, 0.975), 6) AS high, count(*) AS paths FROM s GROUP BY 1""",
        "strategy_returns",
    )
)
def bootstrap_sharpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = stats.bootstrap_sharpe(views.strategy_returns(spark, sf_dir), "r", ["strategy"], "month", paths=2000)
    return b.select("strategy", r6("mean"), r6("low"), r6("high"), "paths")


@query(
    with_views(
        """, rows AS (SELECT strategy, r, row_number() OVER (PARTITION BY strategy ORDER BY month) - 1 AS i FROM strategy_returns),
n AS (SELECT strategy, count(*) AS n FROM rows GROUP BY 1),
d AS (SELECT strategy, p.path, k.k AS step, (('0x' || md5(concat_ws('-', p.path, k.k // 6, 42))[1:12])::BIGINT % n + k.k % 6) % n AS i FROM n, (SELECT unnest(range(10000)) AS path) p, (SELECT unnest(range((SELECT max(n) FROM n))) AS k) k WHERE k.k < n),
navs AS (SELECT strategy, path, step, exp(sum(ln(1 + r)) OVER (PARTITION BY strategy, path ORDER BY step)) AS nav FROM d JOIN rows USING (strategy, i))
SELECT strategy, step::INTEGER AS step, count(*) AS paths, round(avg(nav), 6) AS mean, round(quantile_cont(nav, 0.05), 6) AS p05, round(quantile_cont(nav, 0.25), 6) AS p25, round(median(nav), 6) AS p50,
  round(quantile_cont(nav, 0.75), 6) AS p75, round(quantile_cont(nav, 0.95), 6) AS p95 FROM navs GROUP BY 1, 2""",
        "strategy_returns",
    )
)
def monte_carlo_nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands of 10,000 resampled NAV paths."""
    paths = stats.monte_carlo_paths(views.strategy_returns(spark, sf_dir), "r", ["strategy"], "month")
    bands = stats.path_bands(paths, ["strategy"])
    return bands.select("strategy", "step", "paths", *[r6(c) for c in bands.columns[3:]])


@query(
    with_views(
        """, pool AS (SELECT strategy, r, row_number() OVER (PARTITION BY strategy ORDER BY month) AS i FROM strategy_returns WHERE strategy IN ('1-URGENT', '5-LOW')),
dealt AS (SELECT round, r, CASE WHEN round = 0 THEN strategy = '1-URGENT'
    ELSE row_number() OVER (PARTITION BY round ORDER BY md5(concat_ws('-', strategy, i, round, 42))) <= (SELECT count(*) FROM pool WHERE strategy = '1-URGENT') END AS side
  FROM pool, (SELECT unnest(range(10001)) AS round) rounds),
gaps AS (SELECT round, round((avg(r) FILTER (side) / stddev_samp(r) FILTER (side) - avg(r) FILTER (NOT side) / stddev_samp(r) FILTER (NOT side)) * sqrt(12), 9) AS gap FROM dealt GROUP BY 1)
SELECT round(s.gap, 6) AS gap, avg((abs(g.gap) >= abs(s.gap))::INTEGER) AS p_value, count(*) AS rounds
FROM gaps g, (SELECT gap FROM gaps WHERE round = 0) s WHERE g.round > 0 GROUP BY s.gap""",
        "strategy_returns",
    )
)
def permutation_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.permutation_gap(views.strategy_returns(spark, sf_dir), "r", "strategy", "1-URGENT", "5-LOW", "month", rounds=10000)
    return found.select(r6("gap"), "p_value", "rounds")


@query(
    with_views(
        """, d AS (SELECT DISTINCT month FROM strategy_returns), i AS (SELECT row_number() OVER (ORDER BY month) - 1 AS i, count(*) OVER () AS n FROM d),
g AS (SELECT unnest(range(12)) AS g),
e AS (SELECT g, floor(g * n / 12) AS lo, floor((g + 1) * n / 12) AS hi FROM g, (SELECT max(n) AS n FROM i)),
s AS (SELECT a.g AS g1, a.lo AS lo1, a.hi AS hi1, b.g AS g2, b.lo AS lo2, b.hi AS hi2, row_number() OVER (ORDER BY a.g, b.g) - 1 AS split FROM e a JOIN e b ON a.g < b.g)
SELECT split::INTEGER AS split, g1::INTEGER AS g1, g2::INTEGER AS g2, i::INTEGER AS i, CASE WHEN (i >= lo1 AND i < hi1) OR (i >= lo2 AND i < hi2) THEN 'test'
  WHEN (i >= lo1 - 2 AND i < hi1 + 3) OR (i >= lo2 - 2 AND i < hi2 + 3) THEN 'left_out' ELSE 'train' END AS role
FROM i, s""",
        "strategy_returns",
    )
)
def cpcv_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = views.strategy_returns(spark, sf_dir).select("month").distinct()
    numbered = months.select((F.row_number().over(Window.orderBy("month")) - 1).alias("i"))
    return stats.cpcv_splits(numbered, "i")


@query(
    with_views(
        """, d AS (SELECT symbol, day, volume * px AS dollars, px / lag(px) OVER (PARTITION BY symbol ORDER BY day) - 1 AS ret FROM prices_daily)
SELECT symbol, round(avg(abs(ret) / nullif(dollars, 0)), 12) AS illiquidity, round(avg(dollars), 6) AS adv FROM d GROUP BY 1""",
        "prices_daily",
    )
)
def amihud_illiquidity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = views.prices_daily(spark, sf_dir)
    change = F.try_divide(F.col("px"), F.lag("px").over(Window.partitionBy("symbol").orderBy("day"))) - 1
    own = stats.amihud(d.withColumn("dollars", F.col("px") * F.col("volume")).withColumn("ret", change), "ret", "dollars", ["symbol"])
    return own.select("symbol", F.round("illiquidity", 12).alias("illiquidity"), r6("adv"))


@query(
    with_views(
        _REGIME
        + """, e AS (SELECT e.event_type, r.regime, e.value FROM (SELECT event_type, ts::DATE AS day, value FROM events) e JOIN regime r USING (day))
SELECT regime, event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd FROM e GROUP BY 1, 2""",
        "vix",
    )
)
def regime_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = ts.regimes(views.vix(spark, sf_dir), "close", "day").select("day", "regime")
    e = load(spark, sf_dir, "events").select("event_type", F.to_date("ts").alias("day"), "value").join(days, "day")
    return e.groupBy("regime", "event_type").agg(F.count("*").alias("n"), r6(F.avg("value"), "mean"), r6(F.stddev_samp("value"), "sd"))


@query(
    with_views(
        """SELECT strategy, year(month)::INTEGER AS year, round(exp(sum(ln(1 + r))) - 1, 6) AS ytd, round(max(r) FILTER (month(month) = 1), 6) AS jan, round(max(r) FILTER (month(month) = 12), 6) AS dec FROM strategy_returns GROUP BY 1, 2""",
        "strategy_returns",
    )
)
def calendar_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.strategy_returns(spark, sf_dir)
    at = lambda m, name: r6(F.max(F.when(F.month("month") == m, F.col("r"))), name)
    return s.groupBy("strategy", F.year("month").alias("year")).agg(r6(F.product(1 + F.col("r")) - 1, "ytd"), at(1, "jan"), at(12, "dec"))


# ---------------------------------------------------------------- ratios, text

_FIELD_OF = {"click": "total_revenue", "view": "total_assets", "purchase": "net_income", "login": "total_debt", "logout": "stockholders_equity", "signup": "stockholders_equity", "scroll": "total_debt"}
_RENAMED = "CASE field_name " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _FIELD_OF.items()) + " ELSE field_name END"


@query(
    with_views(
        f""", w AS (SELECT symbol, report_date, {", ".join(f"max(field_value) FILTER ({_RENAMED} = '{f}') AS {f}" for f in ("net_income", "total_revenue", "total_debt", "total_assets", "stockholders_equity"))} FROM fundamentals GROUP BY 1, 2),
r AS (
  SELECT symbol, report_date, 'roe_hist' AS field_name, net_income / nullif(stockholders_equity, 0) AS v FROM w UNION ALL
  SELECT symbol, report_date, 'profit_margin_hist', net_income / nullif(total_revenue, 0) FROM w UNION ALL
  SELECT symbol, report_date, 'roa_hist', net_income / nullif(total_assets, 0) FROM w UNION ALL
  SELECT symbol, report_date, 'debt_to_assets_hist', total_debt / nullif(total_assets, 0) FROM w UNION ALL
  SELECT symbol, report_date, 'debt_to_equity_hist', total_debt / nullif(stockholders_equity, 0) FROM w UNION ALL
  SELECT symbol, report_date, 'equity_ratio_hist', stockholders_equity / nullif(total_assets, 0) FROM w)
SELECT symbol, report_date, field_name, round(v, 6) AS field_value FROM r WHERE abs(v) < 1e15
UNION ALL SELECT symbol, report_date, field_name, round(v, 6) FROM (
  SELECT symbol, report_date, field_name, CASE WHEN abs(p) > 0.001 THEN (x - p) / abs(p) END AS v FROM (
    SELECT symbol, report_date, 'revenue_growth_hist' AS field_name, total_revenue AS x, lag(total_revenue) OVER o AS p FROM w WINDOW o AS (PARTITION BY symbol ORDER BY report_date)
    UNION ALL SELECT symbol, report_date, 'net_income_growth_hist', net_income, lag(net_income) OVER o FROM w WINDOW o AS (PARTITION BY symbol ORDER BY report_date))) WHERE abs(v) < 100""",
        "fundamentals",
    )
)
def historical_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for pair in _FIELD_OF.items() for x in pair])
    facts = views.fundamentals(spark, sf_dir).withColumn("field_name", F.coalesce(F.element_at(names, F.col("field_name")), F.col("field_name")))
    wide = ratios.derived(ratios.wide_facts(facts, ["symbol", "report_date"]).withColumn("price", F.lit(None).cast("double")))
    return ratios.ratio_rows(wide, ["symbol", "report_date"]).unionByName(ratios.growth_rows(wide, ["symbol"], "report_date"))


_BOOST = (
    "CAST(list_sum([0.0] || list_transform(string_split_regex(lower(title), '\\s+'), lambda w: coalesce(map_extract_value(MAP {"
    + ", ".join(f"'{k}': {v}" for k, v in text.WORD_WEIGHTS.items())
    + "}, trim(w, '" + text.PUNCTUATION.replace("'", "''") + "')), 0.0)))"
    + "".join(f" + CASE WHEN contains(lower(title), '{k}') THEN {v} ELSE 0 END" for k, v in text.PHRASE_WEIGHTS.items())
    + " AS DOUBLE)"
)
_TITLES = """, titles AS (SELECT symbol, ordinal, CASE ordinal % 7 WHEN 0 THEN 'Company beats estimates; raised guidance! ' WHEN 1 THEN 'Fraud probe (SEC), profit warning: ' WHEN 2 THEN 'record quarter, dividend ' ELSE '' END || title AS title FROM news)
"""


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = views.news(spark, sf_dir)
    k = F.col("ordinal") % 7
    head = F.when(k == 0, "Company beats estimates; raised guidance! ").when(k == 1, "Fraud probe (SEC), profit warning: ").when(k == 2, "record quarter, dividend ").otherwise("")
    return n.withColumn("title", F.concat(head, "title"))


@query(with_views(_TITLES + f"SELECT symbol, ordinal, round(greatest(least({_BOOST}, 0.5), -0.5), 4) AS boost FROM titles", "news"))
def headline_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.scored_headlines(_titles(spark, sf_dir)).select("symbol", "ordinal", "boost")


@query(
    with_views(
        _TITLES
        + f""", s AS (SELECT symbol, CASE WHEN trim(title, ' ') = '' THEN 0 ELSE round(0.35 * greatest(least({_BOOST}, 0.5), -0.5), 4) END AS s FROM titles),
a AS (SELECT symbol, count(*) AS n, avg(s) AS m, count(*) FILTER (s >= 0.05) AS p, count(*) FILTER (s <= -0.05) AS q, max(s) AS hi, min(s) AS lo, stddev_pop(s) AS d FROM s GROUP BY 1)
SELECT symbol, n AS article_count, round(m, 4) AS avg_sentiment, p AS positive_count, q AS negative_count, n - p - q AS neutral_count, hi AS max_sentiment, lo AS min_sentiment,
  round(p / n, 4) AS positive_ratio, round((m + 1) / 2 * 45 + p / n * 25 + least(n / 20, 1.0) * 20 + greatest(1 - d * 2, 0) * 10, 4) AS sentiment_score, round(d, 4) AS score_dispersion FROM a""",
        "news",
    )
)
def sentiment_by_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.sentiment_summary(text.scored_headlines(_titles(spark, sf_dir)), ["symbol"])


# ---------------------------------------------------------------- grids, regressions, leaves, events


@query(
    with_views(
        _FLAGSHIP
        + """, port AS (SELECT b.month, sum(weight * coalesce(y, 0)) AS gross_ret FROM book b LEFT JOIN fwd USING (symbol, month) GROUP BY 1),
bt AS (SELECT p.month, round(gross_ret, 6) AS g, round(turnover, 6) AS t FROM port p JOIN num USING (month) JOIN turn USING (k)),
net AS (SELECT bp::DOUBLE AS basis_points, g - t * 2 * bp / 1e4 AS r FROM bt, (SELECT unnest([10, 20, 50, 100]) AS bp))
SELECT basis_points, round(avg(r) / stddev_samp(r) * sqrt(12), 6) AS sharpe, round(exp(sum(ln(1 + r)) * 12 / count(*)) - 1, 6) AS ann_return FROM net GROUP BY 1""",
        *_PANEL_VIEWS,
    )
)
def cost_stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = stats.rescaled_costs(factor_backtest(spark, sf_dir), "gross_ret", "turnover", [10, 20, 50, 100], "month")
    return stats.performance(net, "net", ["basis_points"]).select("basis_points", r6("sharpe"), r6("ann_return"))


_WINDOWS = [("early", "1995-01-01", "1996-12-31"), ("middle", "1997-01-01", "1998-12-31"), ("late", "1999-01-01", "2000-12-31")]


@query(
    with_views(
        f""", w AS (SELECT * FROM (VALUES {", ".join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in _WINDOWS)}) t(win, a, b))
SELECT win AS stress_window, strategy, count(*) AS n, round(exp(sum(ln(1 + r))) - 1, 6) AS total, min(r) AS worst FROM strategy_returns JOIN w ON month BETWEEN a AND b GROUP BY 1, 2""",
        "strategy_returns",
    )
)
def stress_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    label: Column = F.lit(None).cast("string")
    for name, a, b in _WINDOWS:  # the windows don't overlap
        label = F.when(F.col("month").between(F.lit(a).cast("date"), F.lit(b).cast("date")), name).otherwise(label)
    s = views.strategy_returns(spark, sf_dir).withColumn("stress_window", label).filter("stress_window is not null")
    return s.groupBy("stress_window", "strategy").agg(F.count("*").alias("n"), r6(F.product(1 + F.col("r")) - 1, "total"), F.min("r").alias("worst"))


@query(
    with_views(
        """, f AS (SELECT strategy, month, r, bench, regr_slope(r, bench) OVER s AS b, avg(r) OVER s AS my, avg(bench) OVER s AS mx FROM strategy_returns WINDOW s AS (PARTITION BY strategy)),
e AS (SELECT *, r - my - b * (bench - mx) AS e, row_number() OVER (PARTITION BY strategy ORDER BY month) AS t FROM f),
m AS (SELECT p.strategy, sum(k * p.e * q.e) AS m11, sum(k * p.e * q.e * (p.bench + q.bench) / 2) AS m12, sum(k * p.e * q.e * p.bench * q.bench) AS m22
  FROM (SELECT p.strategy, p.t, p.e, p.bench FROM e p) p JOIN e q ON p.strategy = q.strategy AND abs(p.t - q.t) <= 4, LATERAL (SELECT 1 - abs(p.t - q.t) / 5 AS k) GROUP BY 1),
s AS (SELECT strategy, count(*) AS n, any_value(b) AS beta, any_value(my) - any_value(b) * any_value(mx) AS alpha, sum(bench) AS sx, sum(bench * bench) AS sxx FROM f GROUP BY 1)
SELECT strategy, n, round(alpha, 6) AS alpha, round(beta, 6) AS beta,
  round(alpha / sqrt((sxx * sxx * m11 - 2 * sxx * sx * m12 + sx * sx * m22) / pow(n * sxx - sx * sx, 2)), 6) AS t_alpha,
  round(beta / sqrt((sx * sx * m11 - 2 * n * sx * m12 + n * n * m22) / pow(n * sxx - sx * sx, 2)), 6) AS t_beta FROM s JOIN m USING (strategy)""",
        "strategy_returns",
    )
)
def hac_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = regression.hac_fit(views.strategy_returns(spark, sf_dir), ["bench"], "r", ["strategy"], "month", lags=4)
    cell = lambda factor, c: F.max(F.when(F.col("factor") == factor, F.col(c)))
    return fit.groupBy("strategy", "n").agg(r6(cell("alpha", "beta"), "alpha"), r6(cell("bench", "beta"), "beta"), r6(cell("alpha", "t"), "t_alpha"), r6(cell("bench", "t"), "t_beta"))


@query(
    with_views(
        """, q AS (SELECT symbol, report_date, arg_max(field_value, event_id) AS v FROM fundamentals WHERE field_name = 'click' GROUP BY 1, 2),
l AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY report_date DESC) AS n FROM q QUALIFY n <= 12),
g AS (SELECT *, lead(v) OVER (PARTITION BY symbol ORDER BY report_date DESC) AS p FROM l),
h AS (SELECT symbol, count(v) AS n_values, count(CASE WHEN abs(p) > 0.001 THEN 1 END) AS growths, least(1 / nullif(stddev_samp(CASE WHEN abs(p) > 0.001 THEN (v - p) / abs(p) END), 0), 100.0) AS s FROM g GROUP BY 1)
SELECT symbol, n_values, growths, round(s, 6) AS stability FROM h WHERE n_values >= 3 AND growths >= 2 AND s IS NOT NULL""",
        "fundamentals",
    )
)
def earnings_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = relational.latest_per_key(views.fundamentals(spark, sf_dir).filter("field_name = 'click'"), ["symbol", "report_date"], ["event_id"])
    return stats.earnings_stability(last, "field_value", ["symbol"], "report_date").select("symbol", F.col("values").alias("n_values"), "growths", r6("stability"))


@query(
    with_views(
        """, w AS (SELECT symbol, report_date, max(field_value) FILTER (field_name = 'purchase') AS o, max(field_value) FILTER (field_name = 'click') AS c, count(*) FILTER (field_name = 'view') AS n FROM fundamentals GROUP BY 1, 2)
SELECT symbol, report_date, 'view' AS field_name, round(o - abs(c), 6) AS field_value FROM w WHERE n = 0 AND o IS NOT NULL AND c IS NOT NULL
UNION ALL SELECT symbol, report_date, field_name, round(max(field_value), 6) FROM fundamentals GROUP BY 1, 2, 3""",
        "fundamentals",
    )
)
def derived_gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = views.fundamentals(spark, sf_dir)
    extra = ratios.free_cash_flow_rows(facts, ["symbol", "report_date"], ocf="purchase", capex="click", fcf="view")
    known = facts.groupBy("symbol", "report_date", "field_name").agg(F.max("field_value").alias("field_value"))
    filled = ratios.gap_filled(known, extra, ["symbol", "report_date", "field_name"])
    return filled.select("symbol", "report_date", "field_name", r6("field_value"))


@query(
    with_views(
        """SELECT month, round(coalesce(sum(volume) FILTER (sector = 'ASIA'), 0), 6) AS "ASIA", round(coalesce(sum(volume) FILTER (sector = 'EUROPE'), 0), 6) AS "EUROPE",
  round(coalesce(sum(volume) FILTER (sector = 'AMERICA'), 0), 6) AS "AMERICA" FROM prices JOIN universe USING (symbol) WHERE sector IN ('ASIA', 'EUROPE', 'AMERICA') GROUP BY 1""",
        "prices",
        "universe",
    )
)
def sector_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    sectors = ["ASIA", "EUROPE", "AMERICA"]
    rows = views.prices(spark, sf_dir).join(views.universe(spark, sf_dir), "symbol").filter(F.col("sector").isin(sectors))
    wide = rows.groupBy("month").pivot("sector", sectors).sum("volume").na.fill(0.0)
    return wide.select("month", *[r6(s) for s in sectors])


@query(
    f"""WITH parts AS ({_PARTS}) SELECT 'a' AS x, 'b' AS y, round(corr(a, b), 6) AS corr FROM parts UNION ALL SELECT 'a', 'c', round(corr(a, c), 6) FROM parts UNION ALL SELECT 'b', 'c', round(corr(b, c), 6) FROM parts"""
)
def factor_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = [("a", "b"), ("a", "c"), ("b", "c")]
    one = _parts(spark, sf_dir).agg(*[scalars.guarded_corr(x, y).alias(f"{x}{y}") for x, y in pairs])
    return one.select(F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"{x}{y}").alias("corr")) for x, y in pairs])).alias("r")).select("r.x", "r.y", r6("r.corr", "corr"))


@query(
    with_views(
        """SELECT symbol, round(avg(px), 6) AS mean, max(px) AS high, min(px) AS low, arg_max(px, month) AS latest, round(arg_max(px, month) / arg_min(px, month) - 1, 6) AS period_return FROM prices GROUP BY 1""",
        "prices",
    )
)
def archive_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.prices(spark, sf_dir)
    last, first = F.max_by("px", "month"), F.min_by("px", "month")
    return p.groupBy("symbol").agg(r6(F.avg("px"), "mean"), F.max("px").alias("high"), F.min("px").alias("low"), last.alias("latest"), r6(last / first - 1, "period_return"))


@query(
    with_views(
        """, b AS (SELECT month, any_value(bench) AS v FROM strategy_returns WHERE bench IS NOT NULL GROUP BY 1),
seen AS (SELECT x.month, count(*) AS n, count(*) FILTER (y.v < x.v) AS under, count(*) FILTER (y.v = x.v) AS same FROM b x JOIN b y ON y.month <= x.month GROUP BY 1),
g AS (SELECT month, CASE WHEN n < 20 THEN 'NORMAL' WHEN (under + (same + 1) / 2) / n < 0.3 THEN 'LOW' WHEN (under + (same + 1) / 2) / n > 0.8 THEN 'HIGH' ELSE 'NORMAL' END AS regime FROM seen),
f AS (SELECT symbol, month, momentum, ret AS reversal FROM returns),
q AS (SELECT month, quantile_cont(momentum, 0.25) AS ml, quantile_cont(momentum, 0.75) AS mh, quantile_cont(reversal, 0.25) AS rl, quantile_cont(reversal, 0.75) AS rh FROM f GROUP BY 1),
d AS (SELECT month, CASE WHEN count(momentum) >= 10 THEN avg(momentum) FILTER (momentum >= mh) - avg(momentum) FILTER (momentum <= ml) ELSE 0 END AS m,
  CASE WHEN count(reversal) >= 10 THEN avg(reversal) FILTER (reversal >= rh) - avg(reversal) FILTER (reversal <= rl) ELSE 0 END AS r FROM f JOIN q USING (month) GROUP BY 1),
t AS (SELECT month, regime, greatest(0.6::DOUBLE * (1 + 0.5 * CASE regime WHEN 'LOW' THEN 0.2 WHEN 'HIGH' THEN -0.4 ELSE 0 END) * (1 + 0.5 * m), 0) AS m,
  greatest(0.4::DOUBLE * (1 + 0.5 * CASE regime WHEN 'HIGH' THEN 0.4 ELSE 0 END) * (1 + 0.5 * r), 0) AS r FROM d JOIN g USING (month))
SELECT month, regime, round(m / (m + r), 6) AS w_momentum, round(r / (m + r), 6) AS w_reversal FROM t""",
        "returns",
        "strategy_returns",
    )
)
def dynamic_factor_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    bench = views.strategy_returns(spark, sf_dir).filter("bench is not null").groupBy("month").agg(F.first("bench").alias("v"))
    regime = ts.regimes(bench, "v", "month").select("month", "regime")
    spread = xs.dispersion(_returns(spark, sf_dir).withColumn("reversal", F.col("ret")), ["momentum", "reversal"], ["month"])
    tilt = {"LOW": {"momentum": 0.2}, "HIGH": {"momentum": -0.4, "reversal": 0.4}}
    w = xs.dynamic_weights({"momentum": 0.6, "reversal": 0.4}, spread, regime, ["month"], tilt)
    return w.select("month", "regime", r6("w_momentum"), r6("w_reversal"))


@query()
def minimum_variance_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _returns(spark, sf_dir).filter("ret is not null").join(views.universe(spark, sf_dir), "symbol")
    return leaves.leg_weights(own, ["sector"], "symbol", "month", "ret").select("sector", "symbol", r6("weight"))


@query()
def risk_parity_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _returns(spark, sf_dir).filter("ret is not null").join(views.universe(spark, sf_dir), "symbol")
    return leaves.leg_weights(own, ["sector"], "symbol", "month", "ret", method="risk_parity").select("sector", "symbol", r6("weight"))


@query(
    with_views(
        """, placed AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY month) AS i FROM strategy_returns),
path(strategy, i, navs, scale) AS (
  SELECT DISTINCT strategy, 0::BIGINT, [1.0::DOUBLE], 1.0::DOUBLE FROM placed
  UNION ALL
  SELECT strategy, i, list_append(navs, navs[-1] * (1 + s * r)), s FROM (
    SELECT p.strategy, d.i, d.r, p.navs, CASE WHEN p.navs[-1] / list_max(p.navs[-13:]) - 1 <= -0.10 THEN 0.5 WHEN p.navs[-1] / list_max(p.navs[-13:]) - 1 <= -0.05 THEN 0.75 ELSE 1 END::DOUBLE AS s
    FROM path p JOIN placed d ON d.strategy = p.strategy AND d.i = p.i + 1))
SELECT strategy, month, scale, round(navs[-1], 6) AS nav FROM path JOIN placed USING (strategy, i)""",
        "strategy_returns",
    ).replace("WITH ", "WITH RECURSIVE ", 1)
)
def scaled_navs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaves.scaled_navs(views.strategy_returns(spark, sf_dir), "r", ["strategy"], "month").select("strategy", "month", "scale", r6("nav"))


#: The normal distribution function in SQL, by logarithms of the same series' terms.
NORMAL_SQL = """, cdf(z, p) AS (SELECT z, CASE WHEN z > 7 THEN 1 WHEN z < -7 THEN 0 WHEN z = 0 THEN 0.5 ELSE
  0.5 + sign(z) * sum(exp((2 * k + 1) * ln(abs(z)) - lgamma(2 * k + 2) + k * ln(2) + lgamma(k + 1) - z * z / 2)) / sqrt(2 * pi()) END
  FROM (SELECT DISTINCT z FROM zs WHERE z IS NOT NULL), (SELECT unnest(range(161))::DOUBLE AS k) GROUP BY z)
"""
_MOMENTS = """, m AS (SELECT strategy, count(*) AS n, avg(r) / stddev_samp(r) AS sr, kurtosis_pop(r) AS k,
  (avg(r*r*r) - 3 * avg(r) * avg(r*r) + 2 * pow(avg(r), 3)) / pow(stddev_pop(r), 3) AS sk FROM strategy_returns GROUP BY 1)"""


@query(
    with_views(
        _MOMENTS
        + """, zs AS (SELECT strategy, sr, CASE WHEN n >= 10 THEN sr * sqrt(n - 1) / sqrt(greatest(1 - sk * sr + (k - 1) / 4 * sr * sr, 1e-12)) END AS z FROM m)"""
        + NORMAL_SQL
        + "SELECT strategy, round(sr, 6) AS sharpe, round(p, 6) AS psr FROM zs LEFT JOIN cdf USING (z)",
        "strategy_returns",
    )
)
def probabilistic_sharpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    monthly = stats.performance(views.strategy_returns(spark, sf_dir), "r", ["strategy"], periods=1)
    psr = stats.probabilistic_sharpe(F.col("sharpe"), 0.0, F.col("n"), F.col("skew"), F.col("excess_kurtosis"))
    return monthly.select("strategy", r6("sharpe"), r6(psr, "psr"))


_LUCK = stats.luckiest_sharpe(15)


_THRESHOLDS = (0.0, 0.5, 1.0)


@query(
    with_views(
        _MOMENTS
        + f""", asked(label, threshold) AS (VALUES ('p0', 0.0), ('p1', 0.5), ('p2', 1.0), ('deflated', {_LUCK!r})),
zs AS (SELECT strategy, label, CASE WHEN n >= 10 THEN (sr - threshold / sqrt(12)) * sqrt(n - 1) / sqrt(greatest(1 - sk * sr + (k - 1) / 4 * sr * sr, 1e-12)) END AS z FROM m, asked)"""
        + NORMAL_SQL
        + f""", psr AS (SELECT strategy, max(p) FILTER (label = 'p0') AS p0, max(p) FILTER (label = 'p1') AS p1, max(p) FILTER (label = 'p2') AS p2, max(p) FILTER (label = 'deflated') AS deflated FROM zs LEFT JOIN cdf USING (z) GROUP BY 1),
nav AS (SELECT strategy, month, exp(sum(ln(1 + r)) OVER (PARTITION BY strategy ORDER BY month)) AS nav FROM strategy_returns),
dd AS (SELECT strategy, month, nav / max(nav) OVER (PARTITION BY strategy ORDER BY month) - 1 AS drawdown FROM nav),
t AS (SELECT strategy, min(drawdown) AS d, arg_min(month, drawdown) AS trough, max(month) AS e FROM dd GROUP BY 1),
dur AS (SELECT strategy, any_value(d) AS d, datediff('month', trough, coalesce(min(dd.month) FILTER (dd.month > trough AND drawdown >= -1e-8), any_value(e)))::INTEGER AS months FROM t JOIN dd USING (strategy) GROUP BY strategy, trough),
a AS (SELECT strategy, exp(sum(ln(1 + r)) * 12 / count(*)) - 1 AS a, stddev_samp(r) * sqrt(12) AS vol, avg(r) * sqrt(12) / stddev_samp(r) FILTER (r < 0) AS sortino, avg((r > 0)::DOUBLE) AS hit, max(r) AS best, min(r) AS worst FROM strategy_returns GROUP BY 1),
ex AS (SELECT strategy, CASE WHEN stddev_samp(r - rf) > 1e-12 THEN avg(r - rf) / stddev_samp(r - rf) * sqrt(12) ELSE 0 END AS excess FROM strategy_returns JOIN factors ON last_day(month) = month_end GROUP BY 1),
q AS (SELECT strategy, quantile_cont(r, 0.01) AS q, count(*) AS n FROM strategy_returns GROUP BY 1),
tail AS (SELECT strategy, -any_value(q) AS var, -avg(r) FILTER (r <= q) AS es, any_value(q.n) AS n FROM strategy_returns JOIN q USING (strategy) GROUP BY 1),
rows AS (SELECT strategy, r, r - bench AS active, row_number() OVER (PARTITION BY strategy ORDER BY month) AS i FROM strategy_returns),
size AS (SELECT strategy, count(*) AS n FROM rows GROUP BY 1),
draw AS (SELECT strategy, p.path, (('0x' || md5(concat_ws('-', p.path, k.k // 3, 42))[1:12])::BIGINT % n + k.k % 3) % n + 1 AS i FROM size, (SELECT unnest(range(2000)) AS path) p, (SELECT unnest(range((SELECT max(n) FROM size))) AS k) k WHERE k.k < n),
sharpes AS (SELECT strategy, path, avg(r) / stddev_samp(r) * sqrt(12) AS s FROM draw JOIN rows USING (strategy, i) GROUP BY 1, 2),
boot AS (SELECT strategy, quantile_cont(s, 0.025) AS low, quantile_cont(s, 0.975) AS high FROM sharpes GROUP BY 1),
flips AS (SELECT strategy, round, avg(CASE WHEN ('0x' || md5(concat_ws('-', strategy, i, round, 42))[32:32])::INTEGER % 2 = 1 THEN -active ELSE active END) AS m FROM rows, (SELECT unnest(range(1, 2001)) AS round) x WHERE active IS NOT NULL GROUP BY 1, 2),
flipped AS (SELECT strategy, (count(*) FILTER (round(abs(m), 12) >= round(abs(mean), 12)) + 1) / (count(*) + 1) AS p_value, any_value(mean) AS mean FROM flips JOIN (SELECT strategy, avg(active) AS mean FROM rows GROUP BY 1) USING (strategy) GROUP BY 1)
SELECT strategy, m.n, round(a, 6) AS ann_return, round(vol, 6) AS ann_vol, round(sr * sqrt(12), 6) AS sharpe, round(excess, 6) AS excess_sharpe, round(low, 6) AS sharpe_low, round(high, 6) AS sharpe_high, round(sortino, 6) AS sortino,
  round(a / abs(d), 6) AS calmar, round(d, 6) AS max_drawdown, months AS drawdown_months, round(sk, 6) AS skew, round(k, 6) AS excess_kurtosis, round(CASE WHEN tail.n >= 30 THEN var ELSE 0.02 END, 6) AS var_99, round(CASE WHEN tail.n >= 30 THEN es ELSE 0.025 END, 6) AS es_99,
  round(hit, 6) AS hit_rate, best, worst, round(p0, 6) AS psr_0, round(p1, 6) AS psr_0_5, round(p2, 6) AS psr_1, round({_LUCK!r}::DOUBLE, 6) AS threshold, round(deflated, 6) AS deflated_sharpe,
  round(mean * 12, 6) AS active_return, round(p_value, 6) AS active_p_value
FROM m JOIN psr USING (strategy) JOIN dur USING (strategy) JOIN a USING (strategy) JOIN ex USING (strategy) JOIN tail USING (strategy) JOIN boot USING (strategy) JOIN flipped USING (strategy)""",
        "strategy_returns",
        "factors",
    )
)
def inference_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per strategy all figures with what they are worth: resampled interval of the Sharpe ratio, its probability beyond thresholds and luck, and a sign-flip test of the active return."""
    series = views.strategy_returns(spark, sf_dir)
    m = stats.performance(series, "r", ["strategy"])
    falls = ts.drawdown_durations(series, "r", ["strategy"], "month")
    riskless = series.withColumn("month_end", F.last_day("month")).join(_factors(spark, sf_dir).select("month_end", "rf"), "month_end").withColumn("x", F.col("r") - F.col("rf"))
    excess = stats.performance(riskless, "x", ["strategy"]).select("strategy", F.col("sharpe").alias("excess_sharpe"))
    tails = pf.tail_risk(series, "r", ["strategy"], confidence=0.99).select("strategy", F.col("var").alias("var_99"), F.col("es").alias("es_99"))
    spread = stats.bootstrap_sharpe(series, "r", ["strategy"], "month", block=3, paths=2000).select("strategy", F.col("low").alias("sharpe_low"), F.col("high").alias("sharpe_high"))
    active = stats.sign_flips(series.withColumn("active", F.col("r") - F.col("bench")), "active", ["strategy"], "month").select("strategy", (F.col("mean") * 12).alias("active_return"), F.col("p_value").alias("active_p_value"))
    whole = m
    for part in (falls, excess, tails, spread, active):
        whole = whole.join(part, "strategy")
    a_month = F.col("sharpe") / 12**0.5
    beyond = lambda x: stats.probabilistic_sharpe(a_month, F.lit(x / 12**0.5), F.col("n"), F.col("skew"), F.col("excess_kurtosis"))
    return whole.select(
        "strategy", "n", *map(r6, ("ann_return", "ann_vol", "sharpe", "excess_sharpe", "sharpe_low", "sharpe_high", "sortino")), r6(stats.calmar(F.col("ann_return"), F.col("max_drawdown")), "calmar"), r6("max_drawdown"),
        F.col("duration_months").alias("drawdown_months"), *map(r6, ("skew", "excess_kurtosis", "var_99", "es_99", "hit_rate")), "best", "worst",
        *[r6(beyond(x), f"psr_{x:g}".replace(".", "_")) for x in _THRESHOLDS], r6(F.lit(_LUCK), "threshold"), r6(beyond(_LUCK), "deflated_sharpe"), r6("active_return"), r6("active_p_value"),
    )


# ---------------------------------------------------------------- sensitivity to the weights' parameters

_GAMMAS, _LAMBDAS = (0.0, 0.25, 0.5, 0.75, 1.0), (0.05, 0.1, 0.15)
_LEANS = {"LOW": {"momentum": 1.0}, "HIGH": {"momentum": -1.0, "value": 1.0, "quality": 1.0}}

_REGIME = """, gb AS (SELECT month, any_value(bench) AS v FROM strategy_returns WHERE bench IS NOT NULL GROUP BY 1),
gseen AS (SELECT x.month, count(*) AS n, count(*) FILTER (y.v < x.v) AS under, count(*) FILTER (y.v = x.v) AS same FROM gb x JOIN gb y ON y.month <= x.month GROUP BY 1),
regime AS (SELECT month, CASE WHEN n < 20 THEN 0.5 ELSE (under + (same + 1) / 2) / n END AS percentile, CASE WHEN n < 20 THEN 'NORMAL' WHEN (under + (same + 1) / 2) / n < 0.3 THEN 'LOW' WHEN (under + (same + 1) / 2) / n > 0.8 THEN 'HIGH' ELSE 'NORMAL' END AS regime FROM gseen)"""


def _lean_sql(factor: str) -> str:
    return "CASE regime " + "".join(f"WHEN '{r}' THEN {t[factor]} " for r, t in _LEANS.items() if factor in t) + "ELSE 0 END"


_DISPERSION = f""", dq AS (SELECT month, {_each("quantile_cont(@, 0.25) AS @_l, quantile_cont(@, 0.75) AS @_h")} FROM z GROUP BY 1),
disp AS (SELECT month, {_each("CASE WHEN count(@) >= 10 THEN avg(@) FILTER (@ >= @_h) - avg(@) FILTER (@ <= @_l) ELSE 0 END AS d_@")} FROM z JOIN dq USING (month) GROUP BY 1)"""


def _dynamic_sql(name: str, by: str, cells: str) -> str:
    """A table of weights for every month and row of ``cells`` (``by``, gamma, lam)."""
    raw = ", ".join(f"greatest({w}::DOUBLE * (1 + lam * {_lean_sql(f) if any(f in t for t in _LEANS.values()) else 0}) * (1 + gamma * d_{f}), 0) AS r_{f}" for f, w in _WEIGHTS.items())
    total = " + ".join(f"r_{f}" for f in _FOUR)
    shares = ", ".join(f"coalesce(r_{f} / nullif({total}, 0), {w}) AS w_{f}" for f, w in _WEIGHTS.items())
    return f""", {name} AS (SELECT {by}, month, {shares} FROM (SELECT {by}, month, {raw} FROM disp JOIN regime USING (month), ({cells}) cells))"""


def _books_sql(p: str, by: str) -> str:
    """From weights ``pw`` (by, month, w_...) to books and net returns ``pnum`` (by, month, i, r, turnover)."""
    return f""", {p}comp AS (SELECT {by}, symbol, month, round(({" + ".join(f"w_{f} * coalesce({f}, 0)" for f in _FOUR)}) * CASE WHEN missing > 0 AND missing < 0.999 THEN 1 / (1 - missing) ELSE 1 END, 9) AS c
  FROM z JOIN (SELECT {p}w.*, {" + ".join(f"(c_{f} = 0)::INTEGER * w_{f}" for f in _FOUR)} AS missing FROM {p}w JOIN held USING (month)) USING (month)),
{p}cut AS (SELECT {by}, month, quantile_cont(c, 0.2) AS lo, quantile_cont(c, 0.8) AS hi FROM {p}comp GROUP BY ALL),
{p}leg AS (SELECT {by}, symbol, month, c, CASE WHEN c >= hi THEN 1 WHEN c <= lo THEN -1 END AS side FROM {p}comp JOIN {p}cut USING ({by}, month)),
{p}up AS (SELECT *, greatest(side * (c - median(c) OVER (PARTITION BY {by}, month, side)), 0) AS u FROM {p}leg WHERE side IS NOT NULL),
{p}book AS (SELECT {by}, symbol, month, (year(month) * 12 + month(month))::INTEGER AS k,
  CASE WHEN sum(u) OVER x > 0 THEN u / sum(u) OVER x ELSE 1.0 / count(*) OVER x END * 0.5 * side AS weight FROM {p}up WINDOW x AS (PARTITION BY {by}, month, side)),
{p}turn AS (SELECT {by}, k, sum(abs(new - old)) / 2 AS turnover FROM (
  SELECT {by}, k, symbol, sum(new) AS new, sum(old) AS old FROM (
    SELECT {by}, k, symbol, weight AS new, 0.0 AS old FROM {p}book UNION ALL SELECT {by}, k + 1, symbol, 0.0, weight FROM {p}book) GROUP BY ALL) GROUP BY ALL),
{p}net AS (SELECT {by}, month, k, any_value(turnover) AS turnover, sum(weight * coalesce(y, 0)) - any_value(turnover) * 2 * 20 / 1e4 AS r FROM {p}book JOIN {p}turn USING ({by}, k) LEFT JOIN fwd USING (symbol, month) GROUP BY ALL),
{p}num AS (SELECT {by}, month, r, turnover, k - min(k) OVER () AS i FROM {p}net WHERE k < (SELECT max(k) FROM {p}net))"""


_CELLS = f"SELECT gamma, lam FROM (SELECT unnest({list(_GAMMAS)})::DOUBLE AS gamma) a, (SELECT unnest({list(_LAMBDAS)})::DOUBLE AS lam) b"
_GRID = (
    _REGIME
    + _DISPERSION
    + _dynamic_sql("gw", "gamma, lam", _CELLS)
    + _books_sql("g", "gamma, lam")
    + f""", gall AS (SELECT gamma, lam, count(*) AS n, avg(r) / stddev_samp(r) AS sr, kurtosis_pop(r) AS kurt, (avg(r*r*r) - 3 * avg(r) * avg(r*r) + 2 * pow(avg(r), 3)) / pow(stddev_pop(r), 3) AS sk FROM gnum GROUP BY ALL),
zs AS (SELECT gamma, lam, n, CASE WHEN n >= 10 THEN (sr - {_LUCK!r} / sqrt(12)) * sqrt(n - 1) / sqrt(greatest(1 - sk * sr + (kurt - 1) / 4 * sr * sr, 1e-12)) END AS z FROM gall)"""
    + NORMAL_SQL
    + """, ge AS (SELECT g, floor(g * n / 12) AS lo, floor((g + 1) * n / 12) AS hi FROM (SELECT unnest(range(12)) AS g), (SELECT max(n) AS n FROM gall)),
gp AS (SELECT a.lo AS lo1, a.hi AS hi1, b.lo AS lo2, b.hi AS hi2, row_number() OVER (ORDER BY a.g, b.g) - 1 AS split FROM ge a JOIN ge b ON a.g < b.g),
fold AS (SELECT gamma, lam, split, i, r, exp(sum(ln(1 + r)) OVER (PARTITION BY gamma, lam, split ORDER BY i)) AS nav FROM gnum JOIN gp ON (i >= lo1 AND i < hi1) OR (i >= lo2 AND i < hi2)),
fdd AS (SELECT *, nav / max(nav) OVER (PARTITION BY gamma, lam, split ORDER BY i) - 1 AS d FROM fold),
cell AS (SELECT gamma, lam, split::INTEGER AS split, count(*) AS n, CASE WHEN stddev_samp(r) > 1e-12 THEN avg(r) / stddev_samp(r) * sqrt(12) ELSE 0 END AS sharpe, min(d) AS max_drawdown FROM fdd GROUP BY ALL)
"""
)


def _market_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    bench = views.strategy_returns(spark, sf_dir).filter("bench is not null").groupBy("month").agg(F.first("bench").alias("v"))
    return ts.regimes(bench, "v", "month").select("month", "percentile", "regime")


def _variant_books(scores: DataFrame, weights: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, month, symbol, y, k, weight): a book for every row of ``weights`` (by, month, w_...), all from one panel of scores.

    What nobody has in a month is counted before the weights multiply the
    panel; of the many books' rows only a score is shuffled, for both legs in one window.
    """
    keys = [*by, "month"]
    held = scores.groupBy("month").agg(*[F.count(f).alias(f"_{f}") for f in _FOUR])
    missing = sum((F.when(F.col(f"_{f}") == 0, F.col(f"w_{f}")).otherwise(0.0) for f in _FOUR), F.lit(0.0))
    scale = F.when((F.col("_missing") > 0) & (F.col("_missing") < 0.999), 1 / (1 - F.col("_missing"))).otherwise(1.0)
    few = weights.join(held, "month").withColumn("_missing", missing).select(*keys, *[f"w_{f}" for f in _FOUR], scale.alias("_scale"))
    total = sum((F.coalesce(F.col(f), F.lit(0.0)) * F.col(f"w_{f}") for f in _FOUR), F.lit(0.0))
    scored = scores.join(F.broadcast(few), "month").select(*keys, "symbol", "y", F.round(total * F.col("_scale"), 9).alias("composite"))
    side = F.when(F.col("long_core"), 1).when(F.col("short_core"), -1).alias("side")
    legs = xs.legs(scored, "composite", keys).select(*keys, "symbol", "y", "composite", side)
    book = pf.score_weights(legs, "composite", "side", keys)
    return book.select(*keys, "symbol", "y", (F.year("month") * 12 + F.month("month")).alias("k"), "weight")


def _variant_returns(scores: DataFrame, weights: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, month, i, r, turnover): net returns of ``_variant_books``."""
    book = checkpointed(_variant_books(scores, weights, by))
    gross = book.groupBy(*by, "month", "k").agg(_paid())
    turned = pf.turnover(pf.book_changes(book, "weight", by, "symbol", "k"), [*by, "k"])
    net = gross.join(turned, [*by, "k"]).withColumn("r", F.col("port_ret") - pf.cost_drag(F.col("turnover"), 20))
    one = Window.partitionBy(*by)
    numbered = net.withColumn("i", F.col("k") - F.min("k").over(one)).withColumn("_last", F.max("k").over(one))
    return numbered.filter("k < _last").select(*by, "month", "i", "r", "turnover")  # the last book has no return yet


def _dynamic(spark: SparkSession, sf_dir: str, scores: DataFrame, cells: Column, keep: Sequence[str]) -> DataFrame:
    """Weights of every month and cell (a struct with gamma, lam and ``keep``)."""
    points = xs.dispersion(scores, _FOUR, ["month"]).withColumn("cell", F.explode(cells)).select("month", *_FOUR, "cell.*")
    regime = _market_regime(spark, sf_dir).select("month", "regime")
    return xs.dynamic_weights(_WEIGHTS, points, regime, ["month"], _LEANS, F.col("gamma"), F.col("lam"), keep=keep).drop("regime")


def _grid_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gamma, lam, i, r): net returns of the book under every pair of parameters, from one scored panel."""
    scores = checkpointed(_scores(spark, sf_dir))
    cells = F.array(*[F.struct(F.lit(g).alias("gamma"), F.lit(x).alias("lam")) for g in _GAMMAS for x in _LAMBDAS])
    weights = _dynamic(spark, sf_dir, scores, cells, ("gamma", "lam"))
    return _variant_returns(scores, weights, ["gamma", "lam"])


@query(with_views(_PANEL + _GRID + "SELECT gamma, lam, split, cell.n, round(sharpe, 6) AS sharpe, round(max_drawdown, 6) AS max_drawdown, round(p, 6) AS deflated_sharpe FROM cell JOIN zs USING (gamma, lam) LEFT JOIN cdf USING (z)", *_PANEL_VIEWS, "strategy_returns"))
def sensitivity_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sharpe ratio and drawdown of every test fold for every pair of parameters, and the pair's deflated ratio over the whole sample."""
    one = Window.partitionBy("gamma", "lam")
    sd = F.stddev_samp("r").over(one)
    whole = _grid_returns(spark, sf_dir).withColumns({"_sr": F.when(sd > 1e-12, F.avg("r").over(one) / sd).otherwise(0.0), "_n": F.count("*").over(one), "_sk": F.skewness("r").over(one), "_k": F.kurtosis("r").over(one)})
    deflated = stats.probabilistic_sharpe(F.col("_sr"), F.lit(_LUCK / 12**0.5), F.col("_n"), F.col("_sk"), F.col("_k"))
    rows = whole.select("gamma", "lam", "i", "r", deflated.alias("deflated"))
    folds = ts.drawdowns(stats.held_out_folds(rows, ["gamma", "lam"], "i"), "r", ["gamma", "lam", "split"], "i")
    fold_sd = F.stddev_samp("r")
    sharpe = F.when(fold_sd > 1e-12, F.avg("r") / fold_sd * 12**0.5).otherwise(0.0)
    out = folds.groupBy("gamma", "lam", "split").agg(F.count("*").alias("n"), r6(sharpe, "sharpe"), r6(F.min("drawdown"), "max_drawdown"), r6(F.first("deflated"), "deflated_sharpe"))
    return out


@query(with_views(_PANEL + _GRID + """, mean AS (SELECT gamma, lam, round(avg(round(sharpe, 6)), 6) AS s FROM cell GROUP BY ALL)
SELECT gamma, max(s) FILTER (lam = 0.05) AS l_0_05, max(s) FILTER (lam = 0.1) AS l_0_1, max(s) FILTER (lam = 0.15) AS l_0_15, max(s) = (SELECT max(s) FROM mean) AS has_best FROM mean GROUP BY 1""", *_PANEL_VIEWS, "strategy_returns"))
def sensitivity_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean ratio of the folds, a row for each gamma and a column for each lambda; the best cell's row is marked."""
    mean = sensitivity_grid(spark, sf_dir).groupBy("gamma", "lam").agg(r6(F.avg("sharpe"), "s"))
    wide = mean.groupBy("gamma").pivot("lam", list(_LAMBDAS)).agg(F.max("s"))
    names = {str(x): f"l_{str(x).replace('.', '_')}" for x in _LAMBDAS}
    best = F.greatest(*[F.col(f"`{x}`") for x in names])
    return wide.select("gamma", *[F.col(f"`{x}`").alias(n) for x, n in names.items()], (best == F.max(best).over(Window.partitionBy(F.lit(0)))).alias("has_best"))


@query(
    with_views(
        _REGIME + """SELECT count(*) AS n, count(*) FILTER (percentile NOT BETWEEN 0 AND 1) AS bad_percentile, count(*) FILTER (regime NOT IN ('LOW', 'NORMAL', 'HIGH')) AS bad_label, count(*) FILTER (regime = 'HIGH') AS bad_weights FROM regime""",
        "strategy_returns",
    )
)
def regime_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The validator over regimes whose weights are wrong in one of them (HIGH), so that it has something to find."""
    rows = _market_regime(spark, sf_dir).withColumn("a", F.when(F.col("regime") == "HIGH", 0.9).otherwise(0.6)).withColumn("b", F.lit(0.4))
    return quality.validate_regimes(rows, "percentile", "regime", ["a", "b"])


@query(
    with_views(
        _PANEL + f""", mean AS (SELECT {_each("avg(@) AS @")} FROM z GROUP BY month, sector),
long AS ({" UNION ALL ".join(f"SELECT '{f}' AS factor, {f} AS m FROM mean" for f in _FOUR)})
SELECT factor, count(*) AS groups, count(*) FILTER (abs(m) > 0.5) AS beyond, count(*) FILTER (abs(m) > 0.5) / count(*) <= 0.5 AS passed FROM long GROUP BY 1""",
        *_PANEL_VIEWS,
    )
)
def factor_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.validate_factors(_scores(spark, sf_dir), _FOUR, ["month", "sector"])


@query(
    with_views(
        """SELECT symbol, 'prices' AS table_name, count(*) AS records, min(month) AS first_date, max(month) AS last_date FROM prices GROUP BY 1
UNION ALL SELECT symbol, 'fundamentals', count(*), min(report_date), max(report_date) FROM fundamentals GROUP BY 1""",
        "prices", "fundamentals",
    )
)
def company_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.company_summary({"prices": (views.prices(spark, sf_dir), "symbol", "month"), "fundamentals": (views.fundamentals(spark, sf_dir), "symbol", "report_date")})


@query(with_views("SELECT count(*) AS total, count(*) FILTER (fx IS NULL) AS null_close, count(*) FILTER (fx <= 0) AS non_positive_rate FROM fx", "fx"))
def fx_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate_quality(views.fx(spark, sf_dir), "fx")


@query(
    with_views(
        """, held AS (SELECT field_name, count(DISTINCT symbol) AS symbols FROM fundamentals SEMI JOIN universe USING (symbol) GROUP BY 1)
SELECT field_name, symbols, round(100.0 * symbols / (SELECT count(*) FROM universe), 6) AS pct FROM held""",
        "fundamentals", "universe",
    )
)
def universe_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the universe that has each field."""
    universe = views.universe(spark, sf_dir)
    held = views.fundamentals(spark, sf_dir).join(universe.select("symbol"), "symbol", "left_semi").groupBy("field_name").agg(F.count_distinct("symbol").alias("symbols"))
    total = F.broadcast(universe.agg(F.count("*").alias("_n")))  # one row
    return held.crossJoin(total).select("field_name", "symbols", r6(100 * F.try_divide(F.col("symbols"), F.col("_n")), "pct"))


_FORWARD_SQL = """, ok AS (SELECT month, momentum AS a, reversal AS b, y FROM (
    SELECT symbol, month, momentum, ret AS reversal, lead(ret) OVER (PARTITION BY symbol ORDER BY month) AS y FROM returns)
  WHERE momentum IS NOT NULL AND reversal IS NOT NULL AND y IS NOT NULL),
s AS (SELECT month, count(*) AS n, sum(a*a) aa, sum(a*b) ab, sum(b*b) bb, sum(a*y) ay, sum(b*y) b_y FROM ok GROUP BY 1 HAVING count(*) >= 10),
f AS (SELECT month, n, aa, bb, aa * bb - ab * ab AS det, (bb * ay - ab * b_y) / (aa * bb - ab * ab) AS m, (aa * b_y - ab * ay) / (aa * bb - ab * ab) AS v FROM s)"""


@query(
    with_views(
        _FORWARD_SQL + """, e AS (SELECT month, sum(pow(y - m * a - v * b, 2)) AS sse, sum(pow(y - my, 2)) AS sst FROM (SELECT *, avg(y) OVER (PARTITION BY month) AS my FROM ok) JOIN f USING (month) GROUP BY 1)
SELECT month, n, round(m, 6) AS beta_momentum, round(v, 6) AS beta_reversal, round(m / sqrt(sse / (n - 2) * bb / det), 4) AS t_momentum,
  round(v / sqrt(sse / (n - 2) * aa / det), 4) AS t_reversal, round(1 - sse / sst, 6) AS r_squared FROM f JOIN e USING (month)""",
        "returns",
    )
)
def factor_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each month's cross-sectional regression with t values and R squared."""
    fit = regression.cross_section_fit(_forward(spark, sf_dir), ["momentum", "reversal"], "y", ["month"])
    four = lambda c: (F.round(c, 4) + 0.0).alias(c)
    return fit.select("month", "n", r6("beta_momentum"), r6("beta_reversal"), four("t_momentum"), four("t_reversal"), r6("r_squared"))


@query(
    with_views(
        _FORWARD_SQL + """, b AS (SELECT month, 'momentum' AS factor, m AS beta FROM f UNION ALL SELECT month, 'reversal', v FROM f)
SELECT month, factor, round(sum(beta) OVER (PARTITION BY factor ORDER BY month), 6) AS premium FROM b""",
        "returns",
    )
)
def cumulative_premium(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running sum of each factor's monthly premium."""
    betas = regression.cross_section_fit(_forward(spark, sf_dir), ["momentum", "reversal"], "y", ["month"])
    long = betas.select("month", F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f"beta_{f}").alias("beta")) for f in ("momentum", "reversal")])).alias("x")).select("month", "x.*")
    w = Window.partitionBy("factor").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    return long.select("month", "factor", r6(F.sum("beta").over(w), "premium"))


@query(
    with_views(
        """, rate AS (SELECT sector, month, fx / lag(fx) OVER (PARTITION BY sector ORDER BY month) AS k FROM fx)
SELECT month, count(*) AS symbols, round(avg((1 + coalesce(ret, 0)) * CASE WHEN k > 0 THEN k ELSE 1 END - 1), 6) AS equal_weight
FROM returns JOIN universe USING (symbol) LEFT JOIN rate USING (sector, month) GROUP BY 1""",
        "returns", "universe", "fx",
    )
)
def equal_weight_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each month's mean return of all symbols in one currency; a rate that is missing or not positive counts as unchanged."""
    rate = views.fx(spark, sf_dir).withColumn("k", F.try_divide(F.col("fx"), F.lag("fx").over(Window.partitionBy("sector").orderBy("month")))).drop("fx")
    own = _returns(spark, sf_dir).join(views.universe(spark, sf_dir), "symbol").join(rate, ["sector", "month"], "left")
    usd = (1 + F.coalesce("ret", F.lit(0.0))) * F.when(F.col("k") > 0, F.col("k")).otherwise(1.0) - 1
    return own.groupBy("month").agg(F.count("*").alias("symbols"), r6(F.avg(usd), "equal_weight"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def stream_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events published as keyed JSON, consumed as a bounded stream and summed."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    events.keyed_messages(load(spark, sf_dir, "events").select("event_id", "event_type", "value"), "event_id").write.parquet(f"{folder}/topic")
    stream = events.decoded(events.read_messages(spark, f"{folder}/topic"), "event_id bigint, event_type string, value double")
    events.consume(stream, lambda df, _: df.write.mode("append").parquet(f"{folder}/out"), f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


# ---------------------------------------------------------------- factor regressions


def _factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regression.month_end_join(views.factor_five(spark, sf_dir), views.factor_momentum(spark, sf_dir), "month")


_SIX = ["mkt_rf", "smb", "hml", "rmw", "cma", "mom"]


@query(with_views(f"SELECT month_end, {', '.join(f'round({c}, 8) AS {c}' for c in [*_SIX, 'rf'])} FROM factors", "factors"))
def factor_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five factors and the riskless rate joined with momentum on month ends, as decimals."""
    return _factors(spark, sf_dir).select("month_end", *[F.round(c, 8).alias(c) for c in [*_SIX, "rf"]])


def _regression_sql(source: str, key: str, day: str = "month") -> str:
    """Gauss-Jordan elimination and the lag-weighted sum of score products, on matrices kept as (row, column, value) rows."""
    return f""", base AS (
  SELECT {key} AS strategy, {day} AS month, r - rf AS y, {", ".join(_SIX)} FROM {source} JOIN factors ON last_day({day}) = month_end
  WHERE {" AND ".join(f"{c} IS NOT NULL" for c in _SIX)} AND r IS NOT NULL AND rf IS NOT NULL),
obs AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY month) AS t, count(*) OVER (PARTITION BY strategy) AS n FROM base),
x AS (SELECT strategy, t, y, unnest(range(7)) AS i, unnest([1.0, {", ".join(_SIX)}]) AS v FROM obs WHERE n >= 10),
xx AS (SELECT a.strategy, a.i, b.i AS j, sum(a.v * b.v) AS v FROM x a JOIN x b USING (strategy, t) GROUP BY 1, 2, 3),
elim(strategy, p, i, j, v) AS (
  SELECT strategy, 0, i, j, v FROM xx UNION ALL SELECT DISTINCT strategy, 0, i, j, (i + 7 = j)::INTEGER::DOUBLE FROM (SELECT DISTINCT strategy, i FROM xx), range(7, 14) r(j)
  UNION ALL
  SELECT strategy, p + 1, i, j, CASE WHEN i = p THEN v / piv ELSE v - vip * vpj / piv END FROM (
    SELECT *, max(v) FILTER (i = p AND j = p) OVER (PARTITION BY strategy) AS piv, max(v) FILTER (j = p) OVER (PARTITION BY strategy, i) AS vip, max(v) FILTER (i = p) OVER (PARTITION BY strategy, j) AS vpj
    FROM elim WHERE p < 7)),
inv AS (SELECT strategy, i, j - 7 AS j, v FROM elim WHERE p = 7 AND j >= 7),
xy AS (SELECT strategy, i AS j, sum(v * y) AS v FROM x GROUP BY 1, 2),
beta AS (SELECT inv.strategy, i, sum(inv.v * xy.v) AS beta FROM inv JOIN xy USING (strategy, j) GROUP BY 1, 2),
res AS (SELECT strategy, t, any_value(y) - sum(v * beta) AS e, any_value(y) AS y FROM x JOIN beta USING (strategy, i) GROUP BY 1, 2),
u AS (SELECT strategy, t, i, v * e AS u FROM x JOIN res USING (strategy, t)),
meat AS (
  SELECT a.strategy, a.i, b.i AS j, sum(a.u * b.u * CASE WHEN a.t = b.t THEN 1 ELSE 1 - abs(a.t - b.t) / 5 END) AS v
  FROM u a JOIN u b ON a.strategy = b.strategy AND b.t BETWEEN a.t - 4 AND a.t + 4 GROUP BY 1, 2, 3),
var AS (SELECT l.strategy, l.i, sum(l.v * meat.v * r.v) AS var FROM inv l JOIN meat ON meat.strategy = l.strategy AND meat.i = l.j JOIN inv r ON r.strategy = l.strategy AND r.i = l.i AND r.j = meat.j GROUP BY 1, 2),
fit AS (SELECT strategy, 1 - sum(e * e) / (sum(y * y) - sum(y) * sum(y) / count(*)) AS r2, count(*) AS n FROM res GROUP BY 1)
"""


_FACTOR_REGRESSION = _regression_sql("strategy_returns", "strategy")
_NAMES = ["alpha", *_SIX]


@query(
    with_views(
        _FACTOR_REGRESSION
        + f"""SELECT strategy, ([{", ".join(f"'{c}'" for c in _NAMES)}])[i + 1] AS factor, round(beta, 6) AS beta, round(sqrt(var), 6) AS se, round(beta / sqrt(var), 4) AS t,
  round(beta - 1.96 * sqrt(var), 6) AS low, round(beta + 1.96 * sqrt(var), 6) AS high, round(r2, 6) AS r_squared, n,
  CASE WHEN i = 0 THEN round(12 * beta, 6) END AS yearly, CASE WHEN i = 0 THEN round(pow(1 + beta, 12) - 1, 6) END AS yearly_compound
FROM beta JOIN var USING (strategy, i) JOIN fit USING (strategy)""",
        "strategy_returns",
        "factors",
    ).replace("WITH ", "WITH RECURSIVE ", 1)
)
def factor_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every strategy on five factors and momentum: loadings with Newey-West errors, t values and intervals, and the yearly alpha."""
    both = views.strategy_returns(spark, sf_dir).withColumn("month_end", F.last_day("month")).join(_factors(spark, sf_dir), "month_end")
    fit = regression.hac_fit(both.withColumn("y", F.col("r") - F.col("rf")), _SIX, "y", ["strategy"], "month")
    own = F.col("factor") == "alpha"
    return fit.select(
        "strategy", "factor", r6("beta"), r6("se"), F.round("t", 4).alias("t"), r6("low"), r6("high"), r6("r_squared"), "n",
        F.when(own, F.round(12 * F.col("beta"), 6)).alias("yearly"), F.when(own, F.round(regression.compounded(F.col("beta")), 6)).alias("yearly_compound"),
    )


# ---------------------------------------------------------------- backtests of variants

_ABLATION = {
    "full_4factor": (0.30, 0.30, 0.25, 0.15),
    "no_momentum": (0.00, 0.44, 0.35, 0.21),
    "no_value": (0.44, 0.00, 0.35, 0.21),
    "no_quality": (0.40, 0.40, 0.00, 0.20),
    "no_sentiment": (0.35, 0.35, 0.30, 0.00),
    "no_sentiment_3factor": (0.35, 0.35, 0.30, 0.00),
    "mom_val_only": (0.50, 0.50, 0.00, 0.00),
    "mom_val_qual": (0.40, 0.40, 0.20, 0.00),
}  # weights of momentum, value, quality, sentiment (fixed values)
#: Dispersion's and the regime's strength.
_COMPARED = {"static": (0.0, 0.0), "vix_only": (0.0, 0.15), "dispersion_only": (0.5, 0.0), "combined": (0.5, 0.15)}

_JUDGED = """, ew AS (SELECT month, avg(coalesce(y, 0)) AS bench FROM fwd GROUP BY 1),
vnav AS (SELECT variant, month, i, r, turnover, bench, exp(sum(ln(1 + r)) OVER (PARTITION BY variant ORDER BY i)) AS nav FROM vnum JOIN ew USING (month)),
judged AS (
  SELECT variant, count(*) AS n, CASE WHEN stddev_samp(r) > 1e-12 THEN avg(r) / stddev_samp(r) * sqrt(12) ELSE 0 END AS sharpe_net, min(nav / peak - 1) AS max_dd,
    CASE WHEN stddev_samp(r - bench) > 0 THEN avg(r - bench) * 12 / (stddev_samp(r - bench) * sqrt(12)) ELSE 0 END AS info_ratio, avg(r) AS mean_monthly, stddev_samp(r) * sqrt(12) AS vol, avg(turnover) * 12 AS turnover
  FROM (SELECT *, max(nav) OVER (PARTITION BY variant ORDER BY i) AS peak FROM vnav) GROUP BY 1)"""


def _judged(returns: DataFrame, panel: DataFrame) -> DataFrame:
    """Per variant: ratio, deepest drawdown, information ratio against all symbols in equal weights, yearly volatility and turnover."""
    equal = panel.groupBy("month").agg(F.avg(F.coalesce("y", F.lit(0.0))).alias("bench"))
    both = ts.drawdowns(returns.join(equal, "month"), "r", ["variant"], "i")
    sd, active = F.stddev_samp("r"), F.col("r") - F.col("bench")
    return both.groupBy("variant").agg(
        F.count("*").alias("n"),
        F.when(sd > 1e-12, F.avg("r") / sd * 12**0.5).otherwise(0.0).alias("sharpe_net"),
        F.min("drawdown").alias("max_dd"),
        F.when(F.stddev_samp(active) > 0, F.avg(active) * 12 / (F.stddev_samp(active) * 12**0.5)).otherwise(0.0).alias("info_ratio"),
        F.avg("r").alias("mean_monthly"),
        (sd * 12**0.5).alias("vol"),
        (F.avg("turnover") * 12).alias("turnover"),
    )


@query(
    with_views(
        _PANEL
        + f""", vw AS (SELECT variant, month, {", ".join(f"w_{f}::DOUBLE AS w_{f}" for f in _FOUR)} FROM (SELECT DISTINCT month FROM z), (VALUES {", ".join(f"('{k}', {', '.join(map(str, v))})" for k, v in _ABLATION.items())}) t(variant, {", ".join(f"w_{f}" for f in _FOUR)}))"""
        + _books_sql("v", "variant")
        + _JUDGED
        + _regression_sql("vnum", "variant", "(month + INTERVAL 1 MONTH)::DATE")
        + """SELECT variant, j.n, round(sharpe_net, 6) AS sharpe_net, round(max_dd, 6) AS max_dd, round(info_ratio, 6) AS info_ratio, round(turnover, 6) AS turnover, round(beta, 6) AS alpha, round(beta / sqrt(var), 4) AS alpha_t
FROM judged j LEFT JOIN (SELECT strategy AS variant, beta, var FROM beta JOIN var USING (strategy, i) WHERE i = 0) USING (variant)""",
        *_PANEL_VIEWS,
        "factors",
    ).replace("WITH ", "WITH RECURSIVE ", 1)
)
def weight_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight backtests, each with its own factor weights, from one scored panel; alpha is that of the regression on six factors."""
    panel = _panel(spark, sf_dir)
    scores = checkpointed(_scores(spark, sf_dir, panel))
    rows = F.array(*[F.struct(F.lit(k).alias("variant"), *[F.lit(w).alias(f"w_{f}") for f, w in zip(_FOUR, v)]) for k, v in _ABLATION.items()])
    weights = scores.select("month").distinct().withColumn("v", F.explode(rows)).select("month", "v.*")
    returns = checkpointed(_variant_returns(scores, weights, ["variant"]))
    own = returns.withColumn("month_end", F.last_day(F.add_months("month", 1))).join(_factors(spark, sf_dir), "month_end").withColumn("y", F.col("r") - F.col("rf"))
    alpha = regression.hac_fit(own, _SIX, "y", ["variant"], "month_end").filter("factor = 'alpha'").select("variant", F.col("beta").alias("alpha"), F.round("t", 4).alias("alpha_t"))
    judged = _judged(returns, panel).join(alpha, "variant", "left")
    return judged.select("variant", "n", r6("sharpe_net"), r6("max_dd"), r6("info_ratio"), r6("turnover"), r6("alpha"), "alpha_t")


@query(
    with_views(
        _PANEL
        + _REGIME
        + _DISPERSION
        + _dynamic_sql("vw", "variant", f"SELECT * FROM (VALUES {', '.join(f"('{k}', {g}::DOUBLE, {x}::DOUBLE)" for k, (g, x) in _COMPARED.items())}) t(variant, gamma, lam)")
        + _books_sql("v", "variant")
        + _JUDGED
        + "SELECT variant, n, round(sharpe_net, 6) AS sharpe_net, round(max_dd, 6) AS max_dd, round(info_ratio, 6) AS info_ratio, round(mean_monthly, 6) AS mean_monthly, round(vol, 6) AS vol FROM judged",
        *_PANEL_VIEWS,
        "strategy_returns",
    )
)
def static_or_dynamic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same book with fixed weights, weights that follow the regime, the dispersion, or both."""
    panel = _panel(spark, sf_dir)
    scores = checkpointed(_scores(spark, sf_dir, panel))
    cells = F.array(*[F.struct(F.lit(k).alias("variant"), F.lit(g).alias("gamma"), F.lit(x).alias("lam")) for k, (g, x) in _COMPARED.items()])
    returns = _variant_returns(scores, _dynamic(spark, sf_dir, scores, cells, ("variant",)), ["variant"])
    return _judged(returns, panel).select("variant", "n", r6("sharpe_net"), r6("max_dd"), r6("info_ratio"), r6("mean_monthly"), r6("vol"))


from marlstone.plans import feeds, reports, strategies  # noqa: E402, F401 (they register their queries)
