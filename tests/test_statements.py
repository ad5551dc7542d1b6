"""Statements of every feed's layout as facts, against values worked out by hand."""

import json

import pytest

from marlstone.operators import snapshot
from marlstone.sources import statements as st


def raw(spark, *docs):
    return spark.createDataFrame([(json.dumps(d),) for d in docs], "value string")


def facts(df):
    return {(r.symbol, str(r.report_date), r.period_type, r.field_name): (r.field_value, r.currency) for r in df.collect()}


def test_concepts(spark):
    line = lambda **k: [{"concept": c, "value": v} for c, v in k.items()]
    doc = {
        "symbol": "A",
        "quarterly": [
            {"endDate": "2024-03-31 00:00:00", "report": {"currency": "EUR", "ic": line(totalRevenue=5, revenue=7, operatingIncome=3, eps="x", epsDiluted=2), "bs": line(longTermDebt=4, totalDebt=9), "cf": line(depreciation=-2, operatingCashflow=10, capitalExpenditure=-4)}},
            {"period": "2024-03-31", "report": {"ic": line(netIncome=1, revenue=99)}},
            {"endDate": "nonsense", "report": {"ic": line(netIncome=1)}},
        ],
        "annual": [{"endDate": "2023-12-31", "report": {"ic": line(ebitda=8, operatingIncome=1, netIncome=None), "cf": line(depreciation=1)}}, {"endDate": "2022-12-31"}],
    }
    got = facts(st.statement_facts(st.concept_items(raw(spark, doc)), st.CONCEPTS, by_rule=False))
    q, y = ("A", "2024-03-31", "quarterly"), ("A", "2023-12-31", "annual")
    # the first of a list wins, also where it is no number (eps); helpers go
    assert got == {
        (*q, "total_revenue"): (5, "EUR"), (*q, "operating_income"): (3, "EUR"), (*q, "total_debt"): (4, "EUR"), (*q, "operating_cash_flow"): (10, "EUR"), (*q, "capital_expenditure"): (-4, "EUR"),
        (*q, "net_income"): (1, "EUR"), (*q, "ebitda"): (5, "EUR"), (*q, "free_cash_flow"): (6, "EUR"), (*y, "ebitda"): (8, "USD"), (*y, "operating_income"): (1, "USD"),
    }


def test_flat_reports(spark):
    doc = {
        "symbol": "B", "period_type": "annual",
        "income": [{"date": "2024-12-31", "reportedCurrency": "GBP", "operatingIncome": 5, "revenue": "12.5", "epsdiluted": None}, {"date": "2024-12-31", "revenue": 1, "netIncome": 2}, {"netIncome": 3}],
        "balance": [{"filingDate": "2023-12-31T00:00", "totalDebt": 7}],
        "cashflow": [{"date": "2024-12-31", "depreciationAndAmortization": 2, "freeCashFlow": 1, "operatingCashFlow": 9, "capitalExpenditure": 3}],
    }
    got = facts(st.statement_facts(st.flat_items(raw(spark, doc)), st.FLAT))
    k = ("B", "2024-12-31", "annual")
    assert got[(*k, "total_revenue")] == (12.5, "GBP") and got[(*k, "net_income")] == (2, "GBP") and got[(*k, "ebitda")][0] == 7 and got[(*k, "free_cash_flow")][0] == 1
    assert got["B", "2023-12-31", "annual", "total_debt"] == (7, "USD") and len(got) == 8
    assert len(facts(st.statement_facts(st.flat_items(raw(spark, doc)), st.FLAT, since="2024-01-01"))) == 7


def test_compact_matrices(spark):
    doc = {
        "symbol": "C", "period_type": "annual", "columns": ["Report Date", "Fiscal Period", "Currency", "Revenue", "Short Term Debt", "Non-Current Debt", None],
        "data": [["2024-03-31", "Q1", "CHF", "1", "2", None, "9"], ["2023-12-31", "FY", "", "3", None, None, "9"], ["2022-12-31", None, None, None, "2", "5", "9"], [None, "Q1", "CHF", "1", "2", "3", "9"]],
    }
    got = facts(st.statement_facts(st.compact_items(raw(spark, doc)), st.COMPACT))
    assert got == {
        ("C", "2024-03-31", "quarterly", "total_revenue"): (1, "CHF"), ("C", "2024-03-31", "quarterly", "total_debt"): (2, "CHF"),
        ("C", "2023-12-31", "annual", "total_revenue"): (3, "USD"), ("C", "2022-12-31", "annual", "total_debt"): (7, "USD"),
    }


def test_report_lists(spark):
    doc = {
        "symbol": "D",
        "quarterlyReports": [{"fiscalDateEnding": "2024-06-30", "reportedCurrency": "USD", "eps": "1.5", "totalShareholderEquity": "100", "commonStockSharesOutstanding": "40", "shortLongTermDebtTotal": "None", "shortTermDebt": "None", "longTermDebt": "6", "operatingCashflow": "8", "capitalExpenditures": "3"}],
        "annualReports": [{"fiscalDateEnding": "2023-12-31", "shortLongTermDebtTotal": "5", "longTermDebt": "6", "totalShareholderEquity": "1", "commonStockSharesOutstanding": "0"}],
    }
    got = {k[1:]: v[0] for k, v in facts(st.statement_facts(st.report_items(raw(spark, doc)), st.REPORTS)).items()}
    q, y = ("2024-06-30", "quarterly"), ("2023-12-31", "annual")
    assert got == {
        (*q, "basic_eps"): 1.5, (*q, "diluted_eps"): 1.5, (*q, "stockholders_equity"): 100, (*q, "book_value"): 2.5, (*q, "total_debt"): 6, (*q, "operating_cash_flow"): 8,
        (*q, "capital_expenditure"): 3, (*q, "free_cash_flow"): 5, (*y, "total_debt"): 5, (*y, "stockholders_equity"): 1,
    }


def test_wide_statements_take_the_first_name_that_is_there(spark):
    doc = {"symbol": "E", "period_type": "quarterly", "currency": "CAD", "fields": {"Net Income": {"2024-03-31": 9}, "NetIncomeCommonStockholders": {"2024-03-31": None, "2023-12-31": 4}, "OperatingIncome": {"2024-03-31": 5, "2023-12-31": None}, "Depreciation": {"2024-03-31": -2, "2023-12-31": 1}}}
    got = facts(st.statement_facts(st.wide_items(raw(spark, doc)), st.WIDE))
    assert got == {("E", "2024-03-31", "quarterly", "operating_income"): (5, "CAD"), ("E", "2024-03-31", "quarterly", "ebitda"): (7, "CAD"), ("E", "2023-12-31", "quarterly", "net_income"): (4, "CAD")}


@pytest.mark.parametrize("items, rules", [(st.concept_items, st.CONCEPTS), (st.flat_items, st.FLAT), (st.compact_items, st.COMPACT), (st.report_items, st.REPORTS), (st.wide_items, st.WIDE)])
def test_broken_and_empty_feeds(spark, items, rules):
    rows = spark.createDataFrame([("not json",), ("{}",), (None,), ('{"symbol": "X"}',)], "value string")
    assert st.statement_facts(items(rows), rules).count() == 0
    assert st.statement_facts(items(rows.filter("false")), rules).count() == 0


# snapshots


def _feeds(spark, rows):
    return spark.createDataFrame(rows, "symbol string, info map<string,string>, metric map<string,string>, fast map<string,string>")


FACTS = "symbol string, report_date string, field_name string, field_value double, period_type string"


def test_snapshot_takes_one_feed_and_fills_the_rest(spark):
    info = {"marketCap": "1000", "bookValue": "4", "trailingEps": "2", "sharesOutstanding": "50", "currentPrice": "20", "regularMarketPrice": "0", "netIncomeToCommon": "30", "debtToEquity": "0", "beta": "NaN", "trailingPE": "x", "operatingCashflow": "100"}
    feeds = _feeds(spark, [("A", info, {"beta": "9"}, None), ("B", {}, {"beta": "1.5"}, {"market_cap": "7"}), ("C.L", {}, {"beta": "1.5"}, {"market_cap": "7", "shares": "0"}), ("D", None, None, None)])
    facts = [(s, d, f, v, "quarterly") for s in ("A", "D") for d, f, v in [
        ("2024-03-31", "total_debt", 6.0), ("2024-03-31", "stockholders_equity", 3.0), ("2024-06-30", "net_income", 5.0), ("2024-06-30", "total_revenue", 20.0), ("2024-06-30", "stockholders_equity", 10.0),
        ("2024-06-30", "operating_cash_flow", 8.0), ("2024-06-30", "capital_expenditure", -3.0), ("2024-06-30", "basic_eps", 2.0), ("2024-03-31", "diluted_eps", 1.0), ("2024-03-31", "total_revenue", 0.0005),
        ("2024-06-30", "ebitda", 4.0), ("2024-06-30", "total_assets", 9.0), ("2024-06-30", "total_liabilities", 3.0), ("2024-06-30", "gross_profit", 8.0), ("2024-06-30", "operating_income", 2.0)]]
    facts += [("D", "2024-09-30", "net_income", 1.0, "annual"), ("D", "2024-06-30", "total_debt", None, "quarterly")]
    prices = spark.createDataFrame([("A", 20.0), ("D", 12.0)], "symbol string, price double")
    got = {}
    for r in snapshot.snapshot_ratios(feeds, spark.createDataFrame(facts, FACTS), prices, spark.createDataFrame([("D", 5.0)], "symbol string, shares double")).collect():
        got.setdefault(r.symbol, {})[r.field_name] = (r.field_value, r.source)
    a, d = got["A"], got["D"]
    assert a["market_cap"] == (1000, "info") and a["dividend_yield"] == (0, "default") and a["book_to_price"] == (0.2, "derived") and a["earnings_to_price"] == (0.1, "derived")
    assert a["cashflow_to_price"] == (0.1, "derived") and a["roe_computed"] == (30 / 200, "derived")
    assert a["debt_to_equity"] == (0, "info") and a["debt_to_equity_inv"] == (0.5, "statements")  # of the last quarter with debt and equity
    assert "beta" not in a and a["pe_ratio_trailing"] == (10, "statements") and a["earnings_growth"] == (1, "statements") and "revenue_growth" not in a
    assert got["B"] == {"beta": (1.5, "metric")} and got["C.L"] == {"market_cap": (7, "fast")}
    assert d["shares_outstanding"] == (5, "statements") and d["market_cap"] == (60, "statements") and d["book_value_per_share"] == (2, "statements") and d["price_to_book"] == (6, "statements")
    assert d["free_cash_flow"] == (5, "statements") and d["total_revenue_ttm"] == (80, "statements") and d["current_ratio"] == (3, "statements") and d["gross_margin"] == (0.4, "statements") and d["operating_margin"] == (0.1, "statements")
    assert d["return_on_equity"] == (0.5, "statements") and d["profit_margin"] == (0.25, "statements") and d["operating_cash_flow"] == (8, "statements")
    assert "ev_to_ebitda" not in d and "dividend_yield" not in d


def test_snapshot_maps_have_the_surveyed_sizes():
    assert len(snapshot.INFO) == 28 and len(snapshot.METRIC) == 21 and len(snapshot.FAST) == 4


def test_snapshot_of_an_empty_table(spark):
    none = _feeds(spark, [("A", None, None, None)]).filter("false")
    facts = spark.createDataFrame([("A", "2024-01-01", "x", 1.0, "quarterly")], FACTS)
    assert snapshot.snapshot_ratios(none, facts, spark.createDataFrame([("A", 1.0)], "symbol string, price double")).count() == 0
