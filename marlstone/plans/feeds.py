"""Registered queries of feeds: statements and snapshots in the layouts that providers send, made from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import snapshot
from marlstone.plans import views
from marlstone.plans.queries import query, r6
from marlstone.plans.views import with_views
from marlstone.session import shared_folder
from marlstone.sources import archive
from marlstone.sources import statements as st
from marlstone.sources.tables import load
from marlstone.streaming.incremental import IncrementalStore, latest_facts, run_metrics

# ---------------------------------------------------------------- statements


def _documents(spark: SparkSession, sf_dir: str, kind: int) -> DataFrame:
    """Each company's quarters as one JSON document, in one of four layouts (by symbol modulo 4)."""
    rows = views._quarterly(spark, sf_dir).filter(F.col("symbol") % 4 == kind)
    c = {k: F.col(k) for k in ("p", "q", "pd", "pt")}
    c |= {"oi": F.col("pd") - F.col("pt"), "eps": F.try_divide(F.col("pd"), F.col("q"))}
    day = F.col("day").cast("string")

    def concepts(**cells: Column) -> Column:
        return F.array(*[F.struct(F.lit(k).alias("concept"), v.alias("value")) for k, v in cells.items()])

    def report(**cells: Column) -> Column:
        return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in cells.items()])

    one = {
        0: lambda: {"quarterly": report(endDate=day, report=report(currency="EUR", ic=concepts(totalRevenue=c["p"], netIncome=c["pd"], operatingIncome=c["oi"]), bs=concepts(totalDebt=c["pt"]), cf=concepts(depreciation=-c["q"], operatingCashflow=c["pd"], capitalExpenditure=-c["pt"])))},
        1: lambda: {
            "income": report(date=day, reportedCurrency="GBP", revenue=c["p"], netIncome=c["pd"], eps=c["eps"]),
            "balance": report(date=day, reportedCurrency="GBP", totalStockholdersEquity=c["p"], totalDebt=c["pt"]),
            "cashflow": report(date=day, reportedCurrency="GBP", operatingCashFlow=c["pd"], capitalExpenditure=c["pt"], freeCashFlow=c["pd"]),
        },
        2: lambda: {"data": F.array(day, F.lit("Q1"), F.lit(""), c["p"].cast("string"), c["pd"].cast("string"), c["p"].cast("string"), c["pt"].cast("string"), F.lit(None).cast("string"))},
        3: lambda: {"quarterlyReports": report(fiscalDateEnding=day, reportedCurrency="USD", eps=c["eps"].cast("string"), totalShareholderEquity=c["p"].cast("string"), commonStockSharesOutstanding=c["q"].cast("string"), shortLongTermDebtTotal="None", longTermDebt=c["pt"].cast("string"), operatingCashflow=c["pd"].cast("string"), capitalExpenditures=c["pt"].cast("string"))},
    }[kind]()
    lists = rows.groupBy("symbol").agg(*[F.transform(F.array_sort(F.collect_list(F.struct("day", v.alias("v")))), lambda x: x["v"]).alias(k) for k, v in one.items()])
    extra = [F.lit("quarterly" if kind == 1 else "annual").alias("period_type")]
    if kind == 2:
        extra.append(F.array(*map(F.lit, ("Report Date", "Fiscal Period", "Currency", "Revenue", "Net Income", "Total Equity", "Short Term Debt", "Long Term Debt"))).alias("columns"))
    return lists.select(F.to_json(F.struct(F.col("symbol").cast("string").alias("symbol"), *extra, *one)).alias("value"))


@query(
    with_views(
        """, f AS (
  SELECT symbol, day AS report_date, CASE symbol % 4 WHEN 0 THEN 'EUR' WHEN 1 THEN 'GBP' ELSE 'USD' END AS currency, unnest(CASE symbol % 4
    WHEN 0 THEN [{'f': 'total_revenue', 'v': p}, {'f': 'net_income', 'v': pd}, {'f': 'operating_income', 'v': pd - pt}, {'f': 'total_debt', 'v': pt}, {'f': 'operating_cash_flow', 'v': pd},
      {'f': 'capital_expenditure', 'v': -pt}, {'f': 'ebitda', 'v': pd - pt + abs(q)}, {'f': 'free_cash_flow', 'v': pd - abs(pt)}]
    WHEN 1 THEN [{'f': 'total_revenue', 'v': p}, {'f': 'net_income', 'v': pd}, {'f': 'basic_eps', 'v': pd / nullif(q, 0)}, {'f': 'stockholders_equity', 'v': p}, {'f': 'total_debt', 'v': pt}, {'f': 'operating_cash_flow', 'v': pd},
      {'f': 'capital_expenditure', 'v': pt}, {'f': 'free_cash_flow', 'v': pd}]
    WHEN 2 THEN [{'f': 'total_revenue', 'v': p}, {'f': 'net_income', 'v': pd}, {'f': 'stockholders_equity', 'v': p}, {'f': 'total_debt', 'v': pt}]
    ELSE [{'f': 'basic_eps', 'v': pd / nullif(q, 0)}, {'f': 'diluted_eps', 'v': pd / nullif(q, 0)}, {'f': 'stockholders_equity', 'v': p}, {'f': 'book_value', 'v': CASE WHEN q > 0 THEN p / q END}, {'f': 'total_debt', 'v': pt},
      {'f': 'operating_cash_flow', 'v': pd}, {'f': 'capital_expenditure', 'v': pt}, {'f': 'free_cash_flow', 'v': pd - abs(pt)}] END) AS x
  FROM quarterly)
SELECT symbol::VARCHAR AS symbol, report_date, x.f AS field_name, round(x.v, 4) AS field_value, 'quarterly' AS period_type, currency FROM f WHERE x.v IS NOT NULL""",
        "quarterly",
    )
)
def statement_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of four layouts as one table of facts, with what can be derived."""
    layouts = [(st.concept_items, st.CONCEPTS, False), (st.flat_items, st.FLAT, True), (st.compact_items, st.COMPACT, True), (st.report_items, st.REPORTS, True)]
    parts = [st.statement_facts(items(_documents(spark, sf_dir, k)), rules, by_rule) for k, (items, rules, by_rule) in enumerate(layouts)]
    found = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return found.select("symbol", "report_date", "field_name", F.round("field_value", 4).alias("field_value"), "period_type", "currency")


# ---------------------------------------------------------------- snapshots

_SNAPSHOT = """, ls AS (SELECT * FROM quarterly QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY day DESC) = 1),
lastpx AS (SELECT l_suppkey AS symbol, arg_max(px, day) AS price FROM (SELECT l_suppkey, l_shipdate::DATE AS day, round(avg(l_extendedprice / l_quantity), 6) AS px FROM lineitem GROUP BY 1, 2) GROUP BY 1),
lf AS (SELECT symbol, arg_max(eq, d) AS eq, arg_max(ni, d) AS ni, arg_max(rev, d) AS rev, arg_max(debt, d) AS debt, arg_max(eps, d) AS eps, list(eps ORDER BY d DESC) AS es, list(rev ORDER BY d DESC) AS rs FROM (
  SELECT symbol, report_date AS d, max(field_value) FILTER (field_name = 'stockholders_equity') AS eq, max(field_value) FILTER (field_name = 'net_income') AS ni, max(field_value) FILTER (field_name = 'total_revenue') AS rev,
    max(field_value) FILTER (field_name = 'total_debt') AS debt, max(field_value) FILTER (field_name = 'diluted_eps') AS eps FROM statement_facts GROUP BY 1, 2) GROUP BY 1),
base AS (SELECT symbol, ls.symbol % 3 AS k, ls.symbol % 6 = 5 AS bare, round(p, 6) AS p, round(q, 6) AS q, round(pd, 6) AS pd, round(pt / q, 6) AS bv, round(pd / q, 6) AS te, round(d, 6) AS d, round(t, 6) AS t, round(p / q, 6) AS px,
  price, eq, ni, rev, debt, eps, CASE WHEN abs(es[2]) > 0.001 THEN (es[1] - es[2]) / abs(es[2]) END AS eg, CASE WHEN abs(rs[2]) > 0.001 THEN (rs[1] - rs[2]) / abs(rs[2]) END AS rg
  FROM ls JOIN lastpx USING (symbol) JOIN lf USING (symbol)),
shared AS (SELECT *, CASE k WHEN 0 THEN q WHEN 1 THEN q END AS shares FROM base),
given AS (
  SELECT symbol, unnest(CASE k WHEN 0 THEN [{'f': 'market_cap', 'v': p, 's': 'info'}, {'f': 'book_value_per_share', 'v': bv, 's': 'info'}, {'f': 'trailing_eps', 'v': te, 's': 'info'}, {'f': 'operating_cash_flow', 'v': pd, 's': 'info'},
      {'f': 'shares_outstanding', 'v': q, 's': 'info'}, {'f': 'debt_to_equity', 'v': d, 's': 'info'}, {'f': 'dividend_yield', 'v': 0, 's': 'default'}, {'f': 'book_to_price', 'v': bv / px, 's': 'derived'}, {'f': 'earnings_to_price', 'v': te / px, 's': 'derived'},
      {'f': 'cashflow_to_price', 'v': pd / p, 's': 'derived'}, {'f': 'roe_computed', 'v': pd / (bv * q), 's': 'derived'}, {'f': 'debt_to_equity_inv', 'v': 1 / d, 's': 'derived'}]
    WHEN 1 THEN [{'f': 'market_cap', 'v': p, 's': 'metric'}, {'f': 'return_on_equity', 'v': t, 's': 'metric'}, {'f': 'fifty_two_week_high', 'v': px, 's': 'metric'}, {'f': 'shares_outstanding', 'v': q, 's': 'metric'}]
    ELSE CASE WHEN bare THEN [] ELSE [{'f': 'market_cap', 'v': p, 's': 'fast'}, {'f': 'fifty_two_week_high', 'v': px, 's': 'fast'}] END END) AS x FROM shared),
fill AS (
  SELECT symbol, unnest([{'f': 'debt_to_equity', 'v': debt / eq}, {'f': 'debt_to_equity_inv', 'v': eq / debt}, {'f': 'return_on_equity', 'v': ni / eq}, {'f': 'profit_margin', 'v': ni / rev}, {'f': 'total_revenue_ttm', 'v': rev * 4},
    {'f': 'pe_ratio_trailing', 'v': price / eps}, {'f': 'trailing_eps', 'v': eps}, {'f': 'price_to_book', 'v': price / (eq / shares)}, {'f': 'book_value_per_share', 'v': eq / shares}, {'f': 'book_to_price', 'v': eq / shares / price},
    {'f': 'market_cap', 'v': price * shares}, {'f': 'shares_outstanding', 'v': shares}, {'f': 'earnings_growth', 'v': CASE WHEN abs(eg) < 100 THEN eg END}, {'f': 'revenue_growth', 'v': CASE WHEN abs(rg) < 100 THEN rg END}]) AS x FROM shared)
SELECT symbol, x.f AS field_name, round(x.v, 6) AS field_value, x.s AS source FROM given
UNION ALL SELECT symbol, x.f, round(x.v, 6), 'statements' FROM fill WHERE x.v IS NOT NULL AND (symbol, x.f) NOT IN (SELECT (symbol, x.f) FROM given)"""


@query(with_views(_SNAPSHOT, "quarterly", "statement_facts"))
def snapshot_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every company's ratios from the feed that has it, what follows from them, and what its statements fill, with each value's source."""
    rows = views._quarterly(spark, sf_dir)
    last = rows.groupBy("symbol").agg(F.max_by(F.struct("p", "q", "pd", "pt", "d", "t"), "day").alias("x")).select("symbol", "x.*")
    text = lambda c: F.round(c, 6).cast("string")
    p, q, pd, pt = (F.col(c) for c in ("p", "q", "pd", "pt"))

    def told(**cells: Column) -> Column:
        return F.create_map(*[x for k, v in cells.items() for x in (F.lit(k.lstrip("_")), v)])

    nothing = F.create_map().cast("map<string, string>")
    info = told(marketCap=text(p), bookValue=text(pt / q), trailingEps=text(pd / q), operatingCashflow=text(pd), netIncomeToCommon=text(pd), sharesOutstanding=text(q), debtToEquity=text(F.col("d")), regularMarketPrice=text(p / q), grossMargins=F.lit("NaN"), beta=F.lit("Infinity"), forwardPE=F.lit("n/a"))
    metric = told(marketCapitalization=text(p), roeTTM=text(F.col("t")), _52WeekHigh=text(p / q), totalSharesOutstanding=text(q))
    fast = told(market_cap=text(p), shares=F.lit("0.0"), year_high=text(p / q))
    k = F.col("symbol") % 3
    feeds = last.select("symbol", F.when(k == 0, info).otherwise(nothing).alias("info"), F.when(k == 1, metric).otherwise(nothing).alias("metric"), F.when((k == 2) & (F.col("symbol") % 6 != 5), fast).otherwise(nothing).alias("fast"))
    facts = views.statement_facts(spark, sf_dir).withColumn("period_type", F.lit("quarterly"))
    prices = views.prices_by_day(spark, sf_dir).groupBy("symbol").agg(F.max_by("px", "day").alias("price"))
    return snapshot.snapshot_ratios(feeds, facts, prices).select("symbol", "field_name", r6("field_value"), "source")


# ---------------------------------------------------------------- incremental loads

_RUNS = """WITH e AS (SELECT event_id, event_type AS source, ts::DATE AS day, value, CASE WHEN event_id % 97 = 0 THEN NULL ELSE value END AS v FROM events),
one AS (SELECT *, CASE WHEN v IS NULL THEN 'FAILED' ELSE 'SUCCESS' END AS status FROM e WHERE day < DATE '2024-01-16'),
mark AS (SELECT source, max(day) AS m FROM one WHERE status = 'SUCCESS' GROUP BY 1),
two AS (SELECT e.*, CASE WHEN v IS NULL THEN 'FAILED' WHEN day < m - 5 THEN 'SKIPPED' ELSE 'SUCCESS' END AS status FROM e LEFT JOIN mark USING (source) WHERE day >= DATE '2024-01-06'),
logged AS (SELECT '0' AS run_id, source, status, day, event_id FROM one UNION ALL SELECT '1', source, status, day, event_id FROM two)
"""


def _two_runs(spark: SparkSession, sf_dir: str) -> IncrementalStore:
    """A store after two runs: the first days of the events, then later ones and some of the first again."""
    folder = f"{shared_folder(spark)}/incremental-{uuid.uuid4().hex}"
    e = load(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("source"), F.to_date("ts").alias("day"), F.when(F.col("event_id") % 97 != 0, F.col("value")).alias("value"))
    store = IncrementalStore(spark, f"{folder}/store", e.schema, ["source"], "day")
    for part in (e.filter("day < DATE '2024-01-16'"), e.filter("day >= DATE '2024-01-06'")):
        part.write.mode("append").parquet(f"{folder}/input")
        store.run(f"{folder}/input", lambda: F.col("value").isNotNull())
    return store


@query(_RUNS + "SELECT run_id, source, status, count(*) AS rows_affected, min(day) AS date_range_start, max(day) AS date_range_end, 'daily' AS run_frequency, min(CASE WHEN status = 'FAILED' THEN 'invalid row: ' END) AS error_head FROM logged GROUP BY 1, 2, 3")
def incremental_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit log of two incremental runs over growing input."""
    log = _two_runs(spark, sf_dir).log()
    return log.select("run_id", "source", "status", "rows_affected", "date_range_start", "date_range_end", "run_frequency", F.substring("error_message", 1, 13).alias("error_head"))


@query(
    _RUNS
    + """, kept AS (SELECT source, count(DISTINCT event_id) AS facts, round(sum(DISTINCT event_id)) AS ids FROM logged WHERE status = 'SUCCESS' GROUP BY 1),
m AS (SELECT source, count(DISTINCT run_id || status) AS entries, count(*) FILTER (status = 'SUCCESS') AS loaded, count(*) FILTER (status = 'SKIPPED') AS skipped, count(*) FILTER (status = 'FAILED') AS failed,
  round(100 * count(*) FILTER (status = 'SUCCESS') / count(*), 1) AS pct_loaded, max(day) FILTER (status = 'SUCCESS') AS last_success FROM logged GROUP BY 1)
SELECT source, facts, ids::BIGINT AS ids, entries, loaded, skipped, failed, pct_loaded, last_success FROM kept JOIN m USING (source)"""
)
def incremental_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source after two runs: facts (each once), watermark, and rows loaded, skipped and failed."""
    store = _two_runs(spark, sf_dir)
    facts = latest_facts(store.facts(), ["event_id"]).groupBy("source").agg(F.count("*").alias("facts"), F.sum("event_id").alias("ids"))
    return facts.join(run_metrics(store.log(), ["source"]), "source").join(store.watermarks(), "source")


# ---------------------------------------------------------------- archive


@query(
    """SELECT event_type, count(*) AS n, sum((props->>'$.k')::BIGINT)::BIGINT AS total, round(min(value), 6) AS least FROM events
WHERE (props->>'$.k')::DOUBLE >= 50 AND event_type IN ('click', 'purchase') AND event_id % 50 <> 0 GROUP BY 1"""
)
def archive_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as documents without a schema, inserted, found by conditions on paths and read back; not finite values are null and satisfy nothing."""
    folder = f"{shared_folder(spark)}/archive-{uuid.uuid4().hex}"
    e = load(spark, sf_dir, "events")
    k = F.when(F.col("event_id") % 50 == 0, F.lit('{"k": NaN}')).otherwise(F.col("props"))
    text = F.concat(F.lit('{"type": "'), "event_type", F.lit('", "note": "NaN, \\"Infinity\\"", "value": '), F.col("value").cast("string"), F.lit(', "props": '), k, F.lit("}"))
    archive.insert(e.select("event_id", text.alias("value")), folder)
    found = archive.find(spark, folder, {"props.k": {"$gte": 50}, "type": {"$in": ["click", "purchase"]}, "note": 'NaN, "Infinity"', "missing": {"$exists": False}})
    return found.groupBy(archive.at("type", "string").alias("event_type")).agg(F.count("*").alias("n"), F.sum(archive.at("props.k", "long")).alias("total"), r6(F.min(archive.at("value", "double")), "least"))
