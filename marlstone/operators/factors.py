"""Raw factor scores of a point-in-time panel: momentum, value, quality and sentiment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.crosssection import row_mean
from marlstone.operators.relational import latest_per_key
from marlstone.session import checkpointed


def monthly_point_in_time(facts: DataFrame, keys: Sequence[str], on: str, last: DataFrame, month: str, lag_days: int = 0) -> DataFrame:
    """For every month start, each key's latest fact dated at most ``lag_days`` before it.

    A fact holds until the key's next one; the month starts in that interval
    are counted out, up to the one in ``last`` (one row, one column), so facts are shuffled once
    by key, no calendar is collected, and the rows made are those that are asked for.
    """
    until = F.lead(on).over(Window.partitionBy(*keys).orderBy(on))
    last = F.broadcast(last.toDF("_last"))
    held = latest_per_key(facts, [*keys, on], [on]).withColumn("_until", until).crossJoin(last)
    since, before = F.date_add(on, lag_days), F.date_sub(F.date_add("_until", lag_days), 1)
    first = F.when(F.trunc(since, "MM") == since, since).otherwise(F.add_months(F.trunc(since, "MM"), 1))
    final = F.least(F.coalesce(F.trunc(before, "MM"), F.col("_last")), F.col("_last"))
    spans = held.withColumns({"_first": first, "_final": final}).filter("_first <= _final")
    return spans.withColumn(month, F.explode(F.sequence("_first", "_final", F.expr("interval 1 month")))).drop("_until", "_last", "_first", "_final")


def wide(facts: DataFrame, keys: Sequence[str], fields: Sequence[str], name: str = "field_name", value: str = "field_value") -> DataFrame:
    """A column for each field."""
    return facts.groupBy(*keys).agg(*[F.max(F.when(F.col(name) == f, F.col(value))).alias(f) for f in fields])


def first_available(candidates: Sequence[Column], by: Sequence[str]) -> Column:
    """The first candidate that has any value in the group, for the whole group.

    Unlike ``coalesce`` it never mixes sources within a group: a row whose
    value the chosen one lacks stays null.
    """
    w = Window.partitionBy(*by)
    chosen = F.when(F.count(candidates[0]).over(w) > 0, candidates[0])
    for c in candidates[1:]:
        chosen = chosen.when(F.count(c).over(w) > 0, c)
    return chosen


def available(df: DataFrame, candidates: dict[str, Sequence[Column]], by: Sequence[str]) -> DataFrame:
    """Adds ``first_available`` of each name's candidates, chosen by counts per group.

    Groups are dates: their counts are few rows beside the panel, which is neither
    shuffled nor sorted by date. ``df`` is read twice.
    """
    cells = {f"_{name}_{i}": c for name, cs in candidates.items() for i, c in enumerate(cs)}
    there = df.groupBy(*by).agg(*[F.count(c).alias(k) for k, c in cells.items()])
    choice = lambda name, cs: F.coalesce(*[F.when(F.col(f"_{name}_{i}") > 0, F.lit(i)) for i in range(len(cs))]).alias(f"_{name}")
    few = there.select(*by, *[choice(name, cs) for name, cs in candidates.items()])
    found = {}
    for name, cs in candidates.items():
        found[name] = F.when(F.col(f"_{name}") == 0, cs[0])
        for i, c in enumerate(cs[1:], 1):
            found[name] = found[name].when(F.col(f"_{name}") == i, c)
    return df.join(F.broadcast(few), list(by)).withColumns(found).drop(*[f"_{name}" for name in candidates])


def value_candidates(price: str) -> list[list[Column]]:
    """Book, earnings and cash flow per price: ratios first, then statements."""
    per = lambda c: F.try_divide(F.col(c), F.col(price))
    return [
        [F.col("book_to_price_hist"), F.col("book_to_price"), per("book_value_per_share")],
        [F.col("earnings_to_price_hist"), F.col("earnings_to_price"), per("diluted_eps")],
        [F.col("cashflow_to_price_hist"), F.col("cashflow_to_price"), per("free_cash_flow")],
    ]


def quality_candidates() -> list[list[Column]]:
    """Return on equity, margin and inverse leverage: ratios first, then statements."""
    leverage = lambda x: 1 / (F.abs(x) + 0.1)
    equity = F.nullif(F.abs("stockholders_equity"), F.lit(0.0))
    return [
        [F.col("roe_hist"), F.col("roe_computed"), F.col("return_on_equity"), F.try_divide(F.col("net_income"), F.col("stockholders_equity"))],
        [F.col("profit_margin_hist"), F.col("operating_margin_hist"), F.col("earnings_stability"), F.try_divide(F.col("net_income"), F.col("total_revenue"))],
        [leverage(F.col("debt_to_equity_hist")), F.col("debt_to_equity_inv"), leverage(F.abs("total_debt") / equity)],
    ]


RATIO_FIELDS = (
    "book_to_price_hist", "book_to_price", "earnings_to_price_hist", "earnings_to_price", "cashflow_to_price_hist", "cashflow_to_price",
    "roe_hist", "roe_computed", "return_on_equity", "profit_margin_hist", "operating_margin_hist", "earnings_stability", "debt_to_equity_hist", "debt_to_equity_inv",
)
STATEMENT_FIELDS = ("book_value_per_share", "diluted_eps", "free_cash_flow", "net_income", "stockholders_equity", "total_debt", "total_revenue")


def known_then(prices: DataFrame, ratios: DataFrame, statements: DataFrame, sentiment: DataFrame, lag_days: int) -> DataFrame:
    """``prices`` with the latest value of every field, and of sentiment, that was known at each month's start.

    Fields are carried along over a symbol's few dates of facts; prices and what was then known
    are one sequence per symbol, so nothing is joined and facts aren't repeated for the months they hold. A fact without a value is none.
    """
    carried = Window.partitionBy("symbol").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)

    def dated(facts: DataFrame, on: str, fields: Sequence[str], name: str) -> DataFrame:
        by_date = wide(facts.withColumn("_at", F.date_add(on, lag_days)), ["symbol", "_at"], fields)
        return by_date.select("symbol", "_at", F.struct(*[F.last(f, ignorenulls=True).over(carried).alias(f) for f in fields]).alias(name))

    moods = sentiment.groupBy("symbol", F.to_date("day").alias("_at")).agg(F.max("score").alias("_mood"))
    rows = prices.select("symbol", F.col("month").alias("_at"), F.struct(*[c for c in prices.columns if c != "symbol"]).alias("_own"))
    for facts in (dated(ratios, "snapshot_date", RATIO_FIELDS, "_ratios"), dated(statements, "report_date", STATEMENT_FIELDS, "_statements"), moods):
        rows = rows.unionByName(facts, allowMissingColumns=True)
    # facts of a month's first day come before its price
    upto = Window.partitionBy("symbol").orderBy("_at", F.col("_own").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    known = rows.select("symbol", "_own", *[F.last(c, ignorenulls=True).over(upto).alias(c) for c in ("_ratios", "_statements", "_mood")]).filter("_own is not null")
    return known.select("symbol", "_own.*", *[F.col("_ratios")[f].alias(f) for f in RATIO_FIELDS], *[F.col("_statements")[f].alias(f) for f in STATEMENT_FIELDS], F.col("_mood").alias("sentiment"))


def factor_panel(prices: DataFrame, ratios: DataFrame, statements: DataFrame, sentiment: DataFrame, last: DataFrame | None = None, lag_days: int = 45) -> DataFrame:
    """``prices`` (symbol, month, px, momentum, ...) with value, quality and sentiment of what was known at each month's start.

    Ratios and statements are entity-attribute-value facts that are used
    ``lag_days`` after their date, sentiment on its own date. A field that no
    fact has is a column of nulls. Nothing is known in months after the one in ``last`` (one row, one column), where it is given.
    """
    known = known_then(prices, ratios, statements, sentiment, lag_days)
    if last is not None:
        facts = [*RATIO_FIELDS, *STATEMENT_FIELDS, "sentiment"]
        known = known.crossJoin(F.broadcast(last.toDF("_last"))).withColumns({c: F.when(F.col("month") <= F.col("_last"), F.col(c)) for c in facts}).drop("_last")
    return scored(checkpointed(known))


def scored(known: DataFrame) -> DataFrame:
    """Rows of ``known_then`` with value and quality; a field that isn't there is a column of nulls. ``known`` is read twice."""
    parts = {f"_v{i}": c for i, c in enumerate(value_candidates("px"))} | {f"_q{i}": c for i, c in enumerate(quality_candidates())}
    fields = [*RATIO_FIELDS, *STATEMENT_FIELDS]
    whole = known.withColumns({c: F.lit(None).cast("double") for c in fields if c not in known.columns})
    means = {"value": row_mean(["_v0", "_v1", "_v2"]), "quality": row_mean(["_q0", "_q1", "_q2"])}
    return available(whole, parts, ["month"]).withColumns(means).drop(*fields, *parts)
