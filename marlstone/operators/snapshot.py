"""A company's ratios of today: what a feed gives, what follows from it, and what statements can fill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.scalars import safe_float

# Given names and ratios of three feeds (fixed values of their formats).

INFO = {
    "marketCap": "market_cap", "trailingPE": "pe_ratio_trailing", "forwardPE": "pe_ratio_forward", "priceToBook": "price_to_book", "enterpriseToEbitda": "ev_to_ebitda",
    "enterpriseValue": "enterprise_value", "dividendYield": "dividend_yield", "beta": "beta", "returnOnEquity": "return_on_equity", "debtToEquity": "debt_to_equity",
    "currentRatio": "current_ratio", "operatingMargins": "operating_margin", "profitMargins": "profit_margin", "revenueGrowth": "revenue_growth", "earningsGrowth": "earnings_growth",
    "trailingEps": "trailing_eps", "forwardEps": "forward_eps", "pegRatio": "peg_ratio", "shortRatio": "short_ratio", "fiftyTwoWeekHigh": "fifty_two_week_high",
    "fiftyTwoWeekLow": "fifty_two_week_low", "sharesOutstanding": "shares_outstanding", "floatShares": "float_shares", "bookValue": "book_value_per_share",
    "freeCashflow": "free_cash_flow", "operatingCashflow": "operating_cash_flow", "totalRevenue": "total_revenue_ttm", "grossMargins": "gross_margin",
}
METRIC = {
    "marketCapitalization": "market_cap", "peNormalizedAnnual": "pe_ratio_trailing", "priceToBookAnnual": "price_to_book", "dividendYieldIndicatedAnnual": "dividend_yield", "beta": "beta",
    "roeTTM": "return_on_equity", "debtEquityAnnual": "debt_to_equity", "currentRatioAnnual": "current_ratio", "operatingMarginAnnual": "operating_margin", "netProfitMarginTTM": "profit_margin",
    "revenueGrowth3Y": "revenue_growth", "epsNormalizedAnnual": "trailing_eps", "52WeekHigh": "fifty_two_week_high", "52WeekLow": "fifty_two_week_low", "grossMarginAnnual": "gross_margin",
    "totalSharesOutstanding": "shares_outstanding", "bookValueShareAnnual": "book_value_per_share", "freeCashFlowTTM": "free_cash_flow", "operatingCashFlowTTM": "operating_cash_flow",
    "enterpriseValueAnnual": "enterprise_value", "evEbitdaAnnual": "ev_to_ebitda",
}
FAST = {"market_cap": "market_cap", "shares": "shares_outstanding", "year_high": "fifty_two_week_high", "year_low": "fifty_two_week_low"}

_LATEST = ("stockholders_equity", "net_income", "total_revenue", "total_debt", "operating_cash_flow", "total_assets", "total_liabilities", "gross_profit", "operating_income", "capital_expenditure", "ebitda", "diluted_eps", "basic_eps", "shares_outstanding")


def _given(column: str, name: str) -> Column:
    return safe_float(F.try_element_at(column, F.lit(name)))


def _some(c: Column) -> Column:
    """Null for 0."""
    return F.nullif(c, F.lit(0.0))


def _over(a: Column, b: Column, least: float = 0.001) -> Column:
    """a / b where a isn't 0 and |b| is more than ``least``."""
    return F.when(F.abs(b) > least, _some(a) / b)


def _growth(last: Column) -> Column:
    """Change between the last two of an array of (date, value), relative to the first; null from nearly nothing, or of a hundredfold and more."""
    now, then = (F.get(last, F.lit(i))["v"] for i in (0, 1))
    change = F.when(F.abs(then) > 0.001, (now - then) / F.abs(then))
    return F.when(F.abs(change) < 100, change)


def latest_statements(facts: DataFrame) -> DataFrame:
    """Per symbol: fields of its last quarter (l_...), debt and equity of the last quarter that has both, and growth of EPS and revenue.

    A quarter's EPS is the diluted one, or else the basic one.
    """
    rows = facts.filter("period_type = 'quarterly' AND field_value IS NOT NULL")
    quarters = rows.groupBy("symbol", "report_date").agg(*[F.max(F.when(F.col("field_name") == f, F.col("field_value"))).alias(f) for f in _LATEST])
    both = F.struct("total_debt", "stockholders_equity")
    eps = F.coalesce("diluted_eps", "basic_eps")

    def last_two(c: Column) -> Column:
        seen = F.collect_list(F.when(c.isNotNull(), F.struct("report_date", c.alias("v"))))
        return F.slice(F.sort_array(seen, asc=False), 1, 2)

    return quarters.groupBy("symbol").agg(
        *[F.max_by(f, "report_date").alias(f"l_{f}") for f in _LATEST],
        F.max_by(both, F.when(F.col("total_debt").isNotNull() & (_some(F.col("stockholders_equity")).isNotNull()), F.col("report_date"))).alias("_both"),
        _growth(last_two(eps)).alias("eps_growth"),
        _growth(last_two(F.col("total_revenue"))).alias("sales_growth"),
    )


def snapshot_ratios(feeds: DataFrame, facts: DataFrame, prices: DataFrame, shares: DataFrame | None = None) -> DataFrame:
    """(symbol, field_name, field_value, source) of every symbol of ``feeds`` (symbol, info, metric, fast: maps of texts).

    A symbol takes the first feed that gives it anything: info, then metric
    (symbols without a dot), then fast (whose zeros don't count). Info without a dividend
    yield means 0, and five ratios follow from it. Then statements fill what is still
    missing: leverage from the last quarter with debt and equity, others from the last
    quarter, the last price (``prices``: symbol, price) and the shares of the quarter, of the feed
    or as known before (``shares``: symbol, shares). What isn't a finite number never counts;
    filled values are rounded to six places and left out from 1e15 on. ``source`` is info, default, derived,
    metric, fast or statements. All is one row a symbol, joined by symbol.
    """
    known = shares if shares is not None else feeds.select("symbol", F.lit(None).cast("double").alias("shares")).filter("false")
    rows = feeds.join(latest_statements(facts), "symbol", "left").join(prices.select("symbol", "price"), "symbol", "left").join(known.select("symbol", F.col("shares").alias("known_shares")), "symbol", "left")
    rules: list[tuple[str, str, Column]] = []  # field, source, value; in order of priority

    def usable(column: str, fields: dict[str, str]) -> Column:
        return F.coalesce(*[_given(column, name) for name in fields]).isNotNull()

    # info counts where it holds anything, since a missing dividend is a value then
    has_info = F.coalesce(F.size("info") > 0, F.lit(False))
    feed = F.when(has_info, "info").when(usable("metric", METRIC) & ~F.col("symbol").cast("string").contains("."), "metric").otherwise("fast")
    rows = rows.withColumn("_feed", feed)
    of = lambda name, value: F.when(F.col("_feed") == name, value)
    rules += [(field, "info", of("info", _given("info", name))) for name, field in INFO.items()]
    rules += [("dividend_yield", "default", of("info", F.lit(0.0)))]
    info = {name: _given("info", name) for name in (*INFO, "regularMarketPrice", "currentPrice", "netIncomeToCommon", "totalStockholderEquity")}
    price = F.coalesce(_some(info["regularMarketPrice"]), info["currentPrice"])
    price = F.when(price > 0, price)
    equity = F.coalesce(_some(info["totalStockholderEquity"]), F.when(info["sharesOutstanding"] > 0, info["bookValue"] * info["sharesOutstanding"]))
    derived = {
        "book_to_price": info["bookValue"] / price,
        "earnings_to_price": info["trailingEps"] / price,
        "cashflow_to_price": F.when(price.isNotNull() & (info["marketCap"] > 0), info["operatingCashflow"] / info["marketCap"]),
        "roe_computed": info["netIncomeToCommon"] / _some(equity),
        "debt_to_equity_inv": 1 / _some(info["debtToEquity"]),
    }
    rules += [(field, "derived", of("info", value)) for field, value in derived.items()]
    rules += [(field, "metric", of("metric", _given("metric", name))) for name, field in METRIC.items()]
    rules += [(field, "fast", of("fast", _some(_given("fast", name)))) for name, field in FAST.items()]

    q = {f: F.col(f"l_{f}") for f in _LATEST}
    leverage = F.col("_both.total_debt") / F.col("_both.stockholders_equity")
    eps, cost = F.coalesce(_some(q["diluted_eps"]), q["basic_eps"]), _some(F.col("price"))
    count = F.coalesce(_some(q["shares_outstanding"]), *[_some(v) for f, _, v in rules if f == "shares_outstanding"], _some(F.col("known_shares")))
    count = F.when(count > 0, count)
    per_share = _some(q["stockholders_equity"]) / F.when(cost.isNotNull(), count)
    per_share = F.when(per_share > 0, per_share)
    value = cost * count
    worth = F.when(F.abs(q["ebitda"]) > 0.001, value + q["total_debt"])
    filled = {
        "debt_to_equity": leverage,
        "debt_to_equity_inv": 1 / _some(leverage),
        "return_on_equity": _over(q["net_income"], q["stockholders_equity"]),
        "profit_margin": _over(q["net_income"], q["total_revenue"]),
        "operating_margin": _over(q["operating_income"], q["total_revenue"]),
        "gross_margin": _over(q["gross_profit"], q["total_revenue"]),
        "current_ratio": _over(q["total_assets"], q["total_liabilities"]),
        "free_cash_flow": q["operating_cash_flow"] - F.abs(q["capital_expenditure"]),
        "operating_cash_flow": q["operating_cash_flow"],
        "total_revenue_ttm": _some(q["total_revenue"]) * 4,
        "pe_ratio_trailing": _over(cost, eps),
        "trailing_eps": F.when(cost.isNotNull() & (F.abs(eps) > 0.001), eps),
        "price_to_book": cost / per_share,
        "book_value_per_share": per_share,
        "book_to_price": per_share / cost,
        "market_cap": F.when(_some(q["stockholders_equity"]).isNotNull(), value),
        "shares_outstanding": F.when(_some(q["stockholders_equity"]).isNotNull() & cost.isNotNull(), count),
        "ev_to_ebitda": worth / q["ebitda"],
        "enterprise_value": worth,
        "earnings_growth": F.col("eps_growth"),
        "revenue_growth": F.col("sales_growth"),
    }
    rules += [(field, "statements", F.when(F.abs(v) < 1e15, F.round(v, 6))) for field, v in filled.items()]

    fields: dict[str, list[tuple[str, Column]]] = {}
    for field, source, v in rules:
        fields.setdefault(field, []).append((source, v))
    cells = []
    for field, options in fields.items():
        found = F.array(*[F.struct(v.cast("double").alias("v"), F.lit(source).alias("source")) for source, v in options])
        cells.append(F.struct(F.lit(field).alias("field_name"), F.get(F.filter(found, lambda x: x["v"].isNotNull() & ~F.isnan(x["v"]) & (F.abs(x["v"]) < float("inf"))), F.lit(0)).alias("x")))
    long = rows.select("symbol", F.explode(F.array(*cells)).alias("c")).filter("c.x IS NOT NULL")
    return long.select("symbol", "c.field_name", F.col("c.x.v").alias("field_value"), F.col("c.x.source").alias("source"))
