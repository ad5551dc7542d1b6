"""Cleaners, symbols and news layouts on small rows."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from marlstone.operators import crosssection, relational
from marlstone.operators import timeseries as ts
from marlstone.sources import cleaners, parsers

D = dt.date


def test_flattened_names(spark):
    two = spark.createDataFrame([(1, 2, 3)], "`AAPL|Close` int, `AAPL|Adj Close` int, `AAPL|Volume` int")
    assert cleaners.flattened(two).columns == ["close", "adj_close", "volume"]
    other = spark.createDataFrame([(1, 2)], "`Open|AAPL` int, `High|AAPL` int")
    assert cleaners.flattened(other).columns == ["open", "high"]
    assert cleaners.flattened(spark.createDataFrame([(1, 2)], "`Adj  Close` int, Date int")).columns == ["adj_close", "date"]


def test_clean_prices(spark):
    rows = [("2024-01-02 00:00:00", "150", "149", "152", "151", "150.5", "1000000.7"), ("2024-01-03", "NaN", None, "1", "x", "inf", None), ("oops", "1", "1", "1", "1", "1", "1"), ("2024-01-04", "1", "2", "1", "1", "1", "-5")]
    raw = spark.createDataFrame(rows, "`Date` string, `Open` string, `High` string, `Low` string, `Close` string, `Adj Close` string, `Volume` string")
    got = [tuple(r) for r in cleaners.clean_prices(raw, F.lit("A"), F.lit("USD")).orderBy("cob_date").collect()]
    assert got == [("A", D(2024, 1, 2), 150, 152, 149, 151, 150.5, 1000000, "USD"), ("A", D(2024, 1, 3), None, None, 1, None, None, None, "USD")]


def test_clean_fx_index_and_esg(spark):
    raw = spark.createDataFrame([("2024-01-02", "1.25", "1.268"), ("2024-01-03", "1.26", None), (None, "1", "1")], "Date string, Open string, Close string")
    assert [(r.currency_pair, str(r.cob_date), r.open_rate, r.high_rate, r.close_rate) for r in cleaners.clean_fx(raw, F.lit("GBPUSD")).collect()] == [("GBPUSD", "2024-01-02", 1.25, None, 1.268)]
    vix = spark.createDataFrame([("2024-01-02", "13.8", "0"), ("2024-01-03", None, "0")], "Date string, Close string, Volume string")
    assert [(r.close_price, r.volume) for r in cleaners.clean_index(vix).orderBy("cob_date").collect()] == [(13.8, 0), (None, 0)]
    esg = spark.createDataFrame([(" A ", "2024-01-01", "20.5", "1", None), ("B", "2024-01-01", "NaN", "1", "2")], "symbol string, date string, totalEsg string, environmentScore string, socialScore string")
    assert [(r.symbol, r.total_esg, r.environment_score, r.social_score, r.governance_score) for r in cleaners.clean_esg(esg).collect()] == [("A", 20.5, 1, None, None)]


def test_any_valid_close(spark):
    df = spark.createDataFrame([("a", "nan"), ("a", "1.5"), ("b", None), ("b", "x")], "k string, CLOSE string")
    assert {r.k: r.valid for r in cleaners.has_valid_close(df, ["k"]).collect()} == {"a": True, "b": False}


@pytest.mark.parametrize("symbol, exchange, swiss, mapped", [("AAPL ", "AAPL.O", ["AAPL"], "AAPL"), ("VOD.L", "VOD.L", ["VOD.L"], "VOD.LON"), ("NESN.SW", "NESN.SW", ["NESN.SW", "NESN.ZU", "NESN.S"], "NESN.SWX"), ("NOVN.S", "NOVN.S", ["NOVN.SW", "NOVN.ZU", "NOVN.S"], "NOVN.S"), ("BRK.B", "BRK.B", ["BRK.B"], "BRK.B")])
def test_provider_symbols(spark, symbol, exchange, swiss, mapped):
    s = F.col("s")
    row = spark.createDataFrame([(symbol,)], "s string").select(cleaners.with_exchange(s).alias("a"), cleaners.swiss_candidates(s).alias("b"), cleaners.suffix_mapped(s).alias("c")).first()
    assert (row.a, row.b, row.c) == (exchange, swiss, mapped)


def test_filer_ids(spark):
    doc = json.dumps({"0": {"cik_str": 320193, "ticker": "aapl", "title": "x"}, "1": {"cik_str": 7, "ticker": " B "}, "2": {"cik_str": 9, "ticker": "B"}, "3": {"ticker": "C"}})
    got = {r.symbol: r.filer_id for r in cleaners.filer_ids(spark.createDataFrame([(doc,), ("broken",)], "value string")).collect()}
    assert got == {"AAPL": "0000320193", "B": "0000000007"}


def test_news_layouts(spark):
    event = [{"title": "t", "seendate": "20240131T120000Z", "language": "English", "domain": "d"}, {"title": "u", "language": "German"}, {"title": ""}, {"title": "v", "seendate": "bad"}]
    got = parsers.event_articles(spark.createDataFrame([(json.dumps(e),) for e in event], "value string")).collect()
    assert [(r.title, r.publisher, r.published) for r in got] == [("t", "d", dt.datetime(2024, 1, 31, 12)), ("v", "", None)]
    listed = [{"title": " a ", "publishedAt": "2024-01-31T12:00:00Z", "source": {"name": "S"}}, {"title": "[Removed]"}, {"title": None}, {"title": "b"}]
    got = parsers.listed_articles(spark.createDataFrame([(json.dumps(e),) for e in listed], "value string")).collect()
    assert [(r.title, r.publisher, r.published) for r in got] == [("a", "S", dt.datetime(2024, 1, 31, 12)), ("b", "unknown", None)]


def test_quarters_latest_rows_and_momentum_filter(spark):
    q = ts.quarters(spark.createDataFrame([(D(2023, 11, 5), D(2024, 4, 1))], "a date, b date"), "a", "b").orderBy("quarter_start").collect()
    assert [(str(r.quarter_start), str(r.quarter_end), str(r.middle)) for r in q] == [("2023-10-01", "2023-12-31", "2023-11-15"), ("2024-01-01", "2024-03-31", "2024-02-15"), ("2024-04-01", "2024-06-30", "2024-05-16")]
    df = spark.createDataFrame([("a", i, i) for i in range(5)] + [("b", 1, 9)], "k string, d int, v int")
    assert sorted((r.k, r.v) for r in relational.latest_rows(df, ["k"], "d", 2).collect()) == [("a", 3), ("a", 4), ("b", 9)]
    legs = spark.createDataFrame([(True, True, 0.1), (True, True, 0.0), (False, True, None)], "long_core boolean, long_band boolean, m double")
    assert [tuple(r)[:2] for r in crosssection.absolute_momentum(legs, "m").collect()] == [(True, True), (False, False), (False, False)]
