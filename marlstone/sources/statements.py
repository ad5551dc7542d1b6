"""Financial statements of several feeds as facts: one plan of rules instead of a parser for each feed.

Every feed becomes items (symbol, period_type, report_date, currency, given,
value, and where they stood); a rule table says which field a given name means.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.scalars import safe_float
from marlstone.operators.relational import first_per_key

# Given names and their fields, in order of priority (fixed values of the feeds' formats).
# A field that begins with _ only helps to derive others.

#: Nested reports: lists of concept and value under ic, bs and cf.
CONCEPTS = (
    ("revenue", "total_revenue"), ("totalRevenue", "total_revenue"), ("netIncome", "net_income"), ("grossProfit", "gross_profit"), ("operatingIncome", "operating_income"),
    ("ebitda", "ebitda"), ("eps", "diluted_eps"), ("epsBasic", "basic_eps"), ("epsDiluted", "diluted_eps"),
    ("totalAssets", "total_assets"), ("totalLiabilities", "total_liabilities"), ("totalEquity", "stockholders_equity"), ("totalStockholderEquity", "stockholders_equity"),
    ("stockholdersEquity", "stockholders_equity"), ("totalDebt", "total_debt"), ("longTermDebt", "total_debt"), ("bookValuePerShare", "book_value"),
    ("operatingCashflow", "operating_cash_flow"), ("cashFromOperatingActivities", "operating_cash_flow"), ("netCashFromOperatingActivities", "operating_cash_flow"),
    ("capitalExpenditures", "capital_expenditure"), ("capitalExpenditure", "capital_expenditure"), ("freeCashFlow", "free_cash_flow"),
    ("depreciationAmortization", "_depreciation"), ("depreciation", "_depreciation"), ("depreciationAndAmortization", "_depreciation"),
)

#: Three lists of flat reports: income, balance, cashflow.
FLAT = (
    ("revenue", "total_revenue"), ("netIncome", "net_income"), ("grossProfit", "gross_profit"), ("operatingIncome", "operating_income"), ("ebitda", "ebitda"),
    ("eps", "basic_eps"), ("epsdiluted", "diluted_eps"),
    ("totalStockholdersEquity", "stockholders_equity"), ("totalDebt", "total_debt"), ("totalAssets", "total_assets"), ("totalLiabilities", "total_liabilities"), ("bookValuePerShare", "book_value"),
    ("operatingCashFlow", "operating_cash_flow"), ("capitalExpenditure", "capital_expenditure"), ("freeCashFlow", "free_cash_flow"), ("depreciationAndAmortization", "_depreciation"),
)

#: Rows of a columns/data matrix; total debt is the sum of its two parts.
COMPACT = (
    ("Revenue", "total_revenue"), ("Net Income", "net_income"), ("Gross Profit", "gross_profit"), ("Operating Income (EBIT)", "operating_income"), ("EBITDA", "ebitda"),
    ("Earnings Per Share, Basic", "basic_eps"), ("Earnings Per Share, Diluted", "diluted_eps"),
    ("Total Equity", "stockholders_equity"), ("Total Assets", "total_assets"), ("Total Liabilities", "total_liabilities"), ("Book Value per Share", "book_value"),
    ("Net Cash from Operating Activities", "operating_cash_flow"), ("Capital Expenditures", "capital_expenditure"), ("Free Cash Flow", "free_cash_flow"), ("Depreciation & Amortization", "_depreciation"),
    ("Short Term Debt", "_short_debt"), ("Short-Term Debt", "_short_debt"), ("Current Debt", "_short_debt"),
    ("Long Term Debt", "_long_debt"), ("Long-Term Debt", "_long_debt"), ("Non-Current Debt", "_long_debt"),
)
COMPACT_DATES = ("Report Date", "Fiscal Period End", "Period End Date", "date")

#: Reports whose missing values are the text None; one eps stands for both.
REPORTS = (
    ("totalRevenue", "total_revenue"), ("netIncome", "net_income"), ("grossProfit", "gross_profit"), ("operatingIncome", "operating_income"), ("ebitda", "ebitda"), ("eps", "basic_eps"),
    ("totalShareholderEquity", "stockholders_equity"), ("totalAssets", "total_assets"), ("totalLiabilities", "total_liabilities"), ("shortLongTermDebtTotal", "total_debt"),
    ("shortTermDebt", "_short_debt"), ("longTermDebt", "_long_debt"), ("commonStockSharesOutstanding", "_shares"),
    ("operatingCashflow", "operating_cash_flow"), ("capitalExpenditures", "capital_expenditure"),
)

#: Wide statements (names by date); a name that is there at all shuts out those behind it.
WIDE = (
    ("NetIncome", "net_income"), ("NetIncomeCommonStockholders", "net_income"), ("Net Income", "net_income"), ("Net Income Common Stockholders", "net_income"),
    ("TotalRevenue", "total_revenue"), ("OperatingRevenue", "total_revenue"), ("Total Revenue", "total_revenue"), ("Operating Revenue", "total_revenue"),
    ("EBITDA", "ebitda"), ("NormalizedEBITDA", "ebitda"), ("ReconciledEBITDA", "ebitda"), ("Normalized EBITDA", "ebitda"), ("Reconciled EBITDA", "ebitda"),
    ("BasicEPS", "basic_eps"), ("Basic EPS", "basic_eps"), ("DilutedEPS", "diluted_eps"), ("Diluted EPS", "diluted_eps"),
    ("OperatingIncome", "operating_income"), ("OperatingExpense", "operating_income"), ("Operating Income", "operating_income"), ("Operating Expense", "operating_income"),
    ("GrossProfit", "gross_profit"), ("Gross Profit", "gross_profit"),
    ("ReconciledDepreciation", "_depreciation"), ("DepreciationAndAmortization", "_depreciation"), ("DepreciationAmortizationDepletion", "_depreciation"), ("Depreciation", "_depreciation"),
    ("Reconciled Depreciation", "_depreciation"), ("Depreciation And Amortization", "_depreciation"), ("Depreciation Amortization Depletion", "_depreciation"),
    ("OperatingCashFlow", "operating_cash_flow"), ("CashFlowFromContinuingOperatingActivities", "operating_cash_flow"), ("Operating Cash Flow", "operating_cash_flow"),
    ("Cash Flow From Continuing Operating Activities", "operating_cash_flow"), ("CapitalExpenditure", "capital_expenditure"), ("PurchaseOfPPE", "capital_expenditure"), ("Capital Expenditure", "capital_expenditure"),
    ("FreeCashFlow", "free_cash_flow"), ("Free Cash Flow", "free_cash_flow"),
)

_ITEM = ["symbol", "period_type", "report_date", "currency", "given", "value", "place"]


def _day(text: Column) -> Column:
    """The date at the front of a text; null where it is none."""
    return F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd")).cast("date")


def _items(rows: DataFrame, date: Column, currency: Column, pairs: Column, *place: Column) -> DataFrame:
    """Items of reports: ``pairs`` is a map or an array of (key, value), ``place`` what orders the reports."""
    out = rows.select("symbol", "period_type", _day(date).alias("report_date"), F.coalesce(F.nullif(currency, F.lit("")), F.lit("USD")).alias("currency"), F.array(*[p.cast("long") for p in place]).alias("_at"), F.posexplode(pairs).alias("_i", "_item"))
    return out.select("symbol", "period_type", "report_date", "currency", F.col("_item.key").alias("given"), F.col("_item.value").alias("value"), F.concat("_at", F.array(F.col("_i").cast("long"))).alias("place"))


def concept_items(raw: DataFrame, text: str = "value") -> DataFrame:
    """Items of nested reports: {symbol, quarterly: [{endDate or period, report: {currency, ic, bs, cf: [{concept, value}]}}], annual: ...}."""
    line = "array<struct<concept: string, value: string>>"
    report = f"array<struct<endDate: string, period: string, report: struct<currency: string, ic: {line}, bs: {line}, cf: {line}>>>"
    j = F.from_json(text, f"symbol string, quarterly {report}, annual {report}")
    both = raw.select(j.alias("j")).select("j.symbol", F.explode(F.array(*[F.struct(F.lit(p).alias("period_type"), F.col(f"j.{p}").alias("reports")) for p in ("quarterly", "annual")])).alias("p"))
    rows = both.select("symbol", "p.period_type", F.posexplode("p.reports").alias("_n", "r"))
    lines = F.concat(*[F.coalesce(f"r.report.{s}", F.array().cast(line)) for s in ("ic", "bs", "cf")])
    pairs = F.transform(lines, lambda x: F.struct(x["concept"].alias("key"), x["value"].alias("value")))
    return _items(rows, F.coalesce("r.endDate", "r.period"), F.col("r.report.currency"), pairs, F.col("_n"))


def flat_items(raw: DataFrame, text: str = "value") -> DataFrame:
    """Items of flat reports: {symbol, period_type, income: [{date, reportedCurrency, name: value, ...}], balance: ..., cashflow: ...}."""
    report = "array<map<string, string>>"
    j = F.from_json(text, f"symbol string, period_type string, income {report}, balance {report}, cashflow {report}")
    kinds = F.array(*[F.struct(F.lit(i).alias("k"), F.col(f"j.{s}").alias("reports")) for i, s in enumerate(("income", "balance", "cashflow"))])
    rows = raw.select(j.alias("j")).select("j.symbol", "j.period_type", F.explode(kinds).alias("p")).select("symbol", "period_type", "p.k", F.posexplode("p.reports").alias("_n", "r"))
    date = F.coalesce(F.nullif(F.try_element_at("r", F.lit("date")), F.lit("")), F.try_element_at("r", F.lit("filingDate")))
    return _items(rows, date, F.coalesce(F.try_element_at("r", F.lit("reportedCurrency")), F.try_element_at("r", F.lit("currency"))), F.map_entries("r"), F.col("k"), F.col("_n"))


def compact_items(raw: DataFrame, text: str = "value") -> DataFrame:
    """Items of matrices: {symbol, period_type, columns: [name], data: [[value]]}; a row's own period, where it names one, goes before the given one."""
    j = F.from_json(text, "symbol string, period_type string, columns array<string>, data array<array<string>>")
    rows = raw.select(j.alias("j")).select("j.symbol", F.col("j.period_type").alias("_given"), "j.columns", F.posexplode("j.data").alias("_n", "_r"))
    cell = F.filter(F.zip_with("columns", "_r", lambda k, v: F.struct(k.alias("key"), v.alias("value"))), lambda x: x["key"].isNotNull())
    rows = rows.withColumn("r", cell)

    def first(names: Sequence[str]) -> Column:
        def named(name: str) -> Column:
            return F.get(F.filter("r", lambda x: (x["key"] == name) & (x["value"] != "")), F.lit(0))["value"]

        return F.coalesce(*map(named, names))

    said = F.lower(first(("Fiscal Period", "Period", "period")))
    period = F.when(said.startswith("q") | said.contains("quarter"), "quarterly").when(said.contains("annual") | said.isin("fy", "full-year", "full year"), "annual").otherwise(F.col("_given"))
    return _items(rows.withColumn("period_type", period), first(COMPACT_DATES), first(("Currency", "currency")), F.col("r"), F.col("_n"))


def report_items(raw: DataFrame, text: str = "value") -> DataFrame:
    """Items of report lists: {symbol, quarterlyReports: [{fiscalDateEnding, reportedCurrency, name: value, ...}], annualReports: ...}; None is no value."""
    report = "array<map<string, string>>"
    j = F.from_json(text, f"symbol string, quarterlyReports {report}, annualReports {report}")
    kinds = F.array(*[F.struct(F.lit(p).alias("period_type"), F.col(f"j.{p}Reports").alias("reports")) for p in ("quarterly", "annual")])
    rows = raw.select(j.alias("j")).select("j.symbol", F.explode(kinds).alias("p")).select("symbol", "p.period_type", F.posexplode("p.reports").alias("_n", "r"))
    said = F.map_entries(F.map_filter("r", lambda k, v: v != "None"))
    return _items(rows, F.try_element_at("r", F.lit("fiscalDateEnding")), F.try_element_at("r", F.lit("reportedCurrency")), said, F.col("_n"))


def wide_items(raw: DataFrame, rules: Sequence[tuple[str, str]] = WIDE, text: str = "value") -> DataFrame:
    """Items of wide statements: {symbol, period_type, currency, fields: {name: {date: value}}}; only the first name of a field that is there counts, whatever it holds."""
    j = F.from_json(text, "symbol string, period_type string, currency string, fields map<string, map<string, string>>")
    rows = raw.select(j.alias("j")).select("j.*")
    by_field: dict[str, list[str]] = {}
    for name, field in rules:
        by_field.setdefault(field, []).append(name)
    names = F.map_keys("fields")
    chosen = F.array(*[F.get(F.filter(F.array(*map(F.lit, given)), lambda g: F.array_contains(names, g)), F.lit(0)) for given in by_field.values()])
    picked = rows.select("symbol", "period_type", "currency", F.explode(F.filter(chosen, lambda n: n.isNotNull())).alias("given"), "fields")
    values = picked.select("symbol", "period_type", F.coalesce("currency", F.lit("USD")).alias("currency"), "given", F.explode(F.try_element_at("fields", F.col("given"))).alias("d", "value"))
    return values.select("symbol", "period_type", _day(F.col("d")).alias("report_date"), "currency", "given", "value", F.array(F.lit(0).cast("long")).alias("place"))


def statement_facts(items: DataFrame, rules: Sequence[tuple[str, str]], by_rule: bool = True, since: str | None = None) -> DataFrame:
    """(symbol, report_date, field_name, field_value, period_type, currency) of a feed's items.

    Of the items that a field, date and period could have, the first in the
    feed's order counts: by report and then by the rules' order (``by_rule``), or by place
    alone where a report is a list. An item without a value doesn't count; one that isn't a finite
    number does and leaves the field empty. Then, where missing: total debt from its two
    parts (one of them is enough), diluted EPS from basic, book value from equity and
    shares, EBITDA as operating income and |depreciation|, free cash flow as operating cash flow less |capital
    expenditure|. One shuffle by (symbol, date, period); a key's items are few.
    """
    known = F.create_map(*[x for i, (name, field) in enumerate(rules) for x in (F.lit(name), F.struct(F.lit(i).cast("long").alias("i"), F.lit(field).alias("field")))])
    rows = items.withColumn("_to", F.try_element_at(known, F.col("given"))).filter("_to is not null and value is not null and report_date is not null")
    if since:
        rows = rows.filter(F.col("report_date") >= F.lit(since).cast("date"))
    last = F.size("place")
    order = F.concat(F.slice("place", F.lit(1), last - 1), F.array(F.col("_to.i"))) if by_rule else F.col("place")
    keys = ["symbol", "report_date", "period_type"]
    picked = first_per_key(rows.select(*keys, F.col("_to.field").alias("field_name"), "currency", safe_float(F.col("value")).alias("field_value"), order.alias("_order")), [*keys, "field_name"], ["_order"])
    facts = picked.filter("field_value is not null").groupBy(*keys).agg(F.min_by("currency", F.struct("_order", "field_name")).alias("currency"), F.map_from_entries(F.collect_list(F.struct("field_name", "field_value"))).alias("m"))
    get = lambda f: F.try_element_at("m", F.lit(f))
    zero = F.lit(0.0)
    debt = F.when(get("_short_debt").isNotNull() | get("_long_debt").isNotNull(), F.coalesce(get("_short_debt"), zero) + F.coalesce(get("_long_debt"), zero))
    given = {field for _, field in rules}
    derived = {
        "total_debt": debt,
        "book_value": F.when(get("_shares") > 0, get("stockholders_equity") / get("_shares")),
        "diluted_eps": get("basic_eps") if "diluted_eps" not in given else F.lit(None).cast("double"),
        "ebitda": get("operating_income") + F.abs(get("_depreciation")),
        "free_cash_flow": get("operating_cash_flow") - F.abs(get("capital_expenditure")),
    }
    extra = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(f).alias("key"), v.alias("value")) for f, v in derived.items()]), lambda x: x["value"].isNotNull() & ~F.map_contains_key("m", x["key"])))
    whole = F.map_filter(F.map_concat("m", extra), lambda k, v: ~k.startswith("_"))
    return facts.select(*keys, "currency", F.explode(whole).alias("field_name", "field_value")).select("symbol", "report_date", "field_name", "field_value", "period_type", "currency")
