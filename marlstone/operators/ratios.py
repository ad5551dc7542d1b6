"""Financial ratios from facts in entity-attribute-value form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.scalars import guarded_ratio

FIELDS = [
    "net_income", "stockholders_equity", "total_debt", "total_revenue", "operating_income", "ebitda", "total_assets", "total_liabilities",
    "operating_cash_flow", "capital_expenditure", "free_cash_flow", "diluted_eps", "basic_eps", "gross_profit", "book_value", "shares_outstanding",
]


def wide_facts(facts: DataFrame, keys: Sequence[str], field: str = "field_name", value: str = "field_value", fields: Sequence[str] = FIELDS) -> DataFrame:
    """One row per key with a column for every field (the largest value where a field repeats)."""
    return facts.groupBy(*keys).agg(*[F.max(F.when(F.col(field) == f, F.col(value))).alias(f) for f in fields])


def unpivoted(wide: DataFrame, keys: Sequence[str], values: Sequence[str], field: str = "field_name", value: str = "field_value") -> DataFrame:
    """Back to rows; nulls are left out."""
    return wide.unpivot(list(keys), list(values), field, value).filter(F.col(value).isNotNull())


def derived(wide: DataFrame, shares_mode: str = "outstanding") -> DataFrame:
    """Fills equity, eps, free cash flow and book value from other fields, and adds shares and market value.

    ``shares_mode`` "reference" takes equity over book value first, which is 1
    where the book value itself is filled from equity; "outstanding" takes the
    reported number of shares first. A missing ebitda stays missing: only the
    operating margin falls back on another field.
    """
    c = F.col
    filled = (
        wide.withColumn("stockholders_equity", F.coalesce("stockholders_equity", F.nullif(c("total_assets"), F.lit(0.0)) - F.nullif(c("total_liabilities"), F.lit(0.0))))
        .withColumn("eps", F.coalesce("diluted_eps", "basic_eps"))
        .withColumn("free_cash_flow", F.coalesce(c("free_cash_flow"), c("operating_cash_flow") - F.abs("capital_expenditure")))
        .withColumn("book_value", F.coalesce("book_value", "stockholders_equity"))
    )
    implied = F.try_divide(F.nullif(c("stockholders_equity"), F.lit(0.0)), c("book_value"))
    implied, known = F.when(implied > 0, implied), F.when(c("shares_outstanding") > 0, c("shares_outstanding"))
    shares = F.coalesce(known, implied) if shares_mode == "outstanding" else F.coalesce(implied, known)
    return filled.withColumn("shares", shares).withColumn("market_value", F.when(c("price") > 0, c("price") * shares))


def historical_ratios(wide: DataFrame) -> dict[str, Column]:
    """The ratios of one report date by name, over ``derived`` columns; undefined ones are null."""
    c = F.col
    r = guarded_ratio
    return {
        "pe_ratio_hist": r(c("price"), c("eps")),
        "debt_to_equity_hist": r(c("total_debt"), c("stockholders_equity")),
        "roe_hist": r(c("net_income"), c("stockholders_equity")),
        "profit_margin_hist": r(c("net_income"), c("total_revenue")),
        "gross_margin_hist": r(c("gross_profit"), c("total_revenue")),
        "operating_margin_hist": r(F.coalesce("operating_income", "ebitda"), c("total_revenue")),
        "ev_to_ebitda_hist": r(c("market_value") + c("total_debt"), c("ebitda")),
        "roa_hist": r(c("net_income"), c("total_assets")),
        "assets_to_liab_hist": r(c("total_assets"), c("total_liabilities")),
        "debt_to_assets_hist": r(c("total_debt"), c("total_assets")),
        "equity_ratio_hist": r(c("stockholders_equity"), c("total_assets")),
        "fcf_yield_hist": r(c("free_cash_flow"), c("market_value")),
        "fcf_margin_hist": r(c("free_cash_flow"), c("total_revenue")),
        "ocf_to_debt_hist": r(c("operating_cash_flow"), c("total_debt")),
        "earnings_to_price_hist": r(c("eps"), c("price")),
        "cashflow_to_price_hist": r(c("operating_cash_flow"), c("market_value")),
        "revenue_to_mcap_hist": r(c("total_revenue"), c("market_value")),
        "ebitda_margin_hist": r(c("ebitda"), c("total_revenue")),
        "book_to_price_hist": F.when(c("book_value") > 0, r(c("book_value"), c("price"))),
        "price_to_book_hist": F.when(c("book_value") > 0, r(c("price"), c("book_value"))),
    }


def ratio_rows(wide: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Historical ratios in rows: keys, field_name, field_value."""
    ratios = historical_ratios(wide)
    return unpivoted(wide.select(*keys, *[v.alias(k) for k, v in ratios.items()]), keys, list(ratios))


GROWTH = {"earnings_growth_hist": "eps", "revenue_growth_hist": "total_revenue", "net_income_growth_hist": "net_income", "ocf_growth_hist": "operating_cash_flow"}


def growth_rows(wide: DataFrame, entity: Sequence[str], date: str, least: float = 0.001, most: float = 100.0) -> DataFrame:
    """Change against the entity's report before over that one's size, in rows (over ``derived`` columns).

    Left out where either value is missing, the one before is not above
    ``least`` in size, or the change is not below ``most``.
    """
    before = Window.partitionBy(*entity).orderBy(date)

    def change(field: str) -> Column:
        old = F.lag(field).over(before)
        rate = F.try_divide(F.col(field) - old, F.abs(old))
        return F.when((F.abs(old) > least) & (F.abs(rate) < most), F.round(rate, 6))

    return unpivoted(wide.select(*entity, date, *[change(f).alias(k) for k, f in GROWTH.items()]), [*entity, date], list(GROWTH))


def gap_filled(facts: DataFrame, extra: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``facts`` and those rows of ``extra`` whose key they lack (add if missing)."""
    return facts.unionByName(extra.join(facts.select(*keys).distinct(), list(keys), "left_anti").select(*facts.columns))


def free_cash_flow_rows(facts: DataFrame, keys: Sequence[str], field: str = "field_name", value: str = "field_value", ocf: str = "operating_cash_flow", capex: str = "capital_expenditure", fcf: str = "free_cash_flow") -> DataFrame:
    """Derived free cash flow for keys that have its parts but not itself."""
    pick = lambda f: F.max(F.when(F.col(field) == f, F.col(value)))
    parts = facts.groupBy(*keys).agg(pick(ocf).alias("_o"), pick(capex).alias("_c"), F.count_if(F.col(field) == fcf).alias("_n"))
    return parts.filter("_n = 0 and _o is not null and _c is not null").select(*keys, F.lit(fcf).alias(field), (F.col("_o") - F.abs("_c")).alias(value))
