"""Operators on small frames: published expectations, edge cases, reference loops."""

import datetime as dt
import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.functions import scalars
from marlstone.operators import crosssection as xs
from marlstone.operators import portfolio as pf
from marlstone.operators import quality, ratios, regression, relational, stats, text
from marlstone.operators import timeseries as ts
from marlstone.sources import parsers
from marlstone.streaming import events


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order or df.columns).collect()]


def test_safe_numbers(spark):
    df = spark.createDataFrame([("1.5",), ("NaN",), ("Infinity",), ("x",), (None,), ("-7.9",)], "v string")
    assert [tuple(r) for r in df.select(scalars.safe_float(F.col("v")), scalars.safe_int(F.col("v"))).collect()] == [(1.5, 1), (None, None), (None, None), (None, None), (None, None), (-7.9, -7)]


@pytest.mark.parametrize("raw,want", [("AAPL   ", ("AAPL", "AAPL", "USD")), ("NOVN.S  ", ("NOVN.S", "NOVN.SW", "CHF")), ("BRK.B", ("BRK.B", "BRK-B", "USD")), ("BARC.L", ("BARC.L", "BARC.L", "GBP")), ("ABX.TO", ("ABX.TO", "ABX.TO", "CAD"))])
def test_feed_symbols(spark, raw, want):
    assert tuple(spark.createDataFrame([(raw,)], "s string").select(scalars.feed_symbol(F.col("s")).alias("t")).select("t.*").first()) == want


def test_point_in_time_lag_and_ties(spark):
    d = dt.date
    facts = spark.createDataFrame([("a", d(2024, 1, 1), 1, 10.0), ("a", d(2024, 1, 1), 2, 11.0), ("a", d(2024, 2, 1), 3, 12.0), ("b", d(2024, 3, 1), 4, 5.0)], "k string, on date, id int, v double")
    got = relational.point_in_time(facts, ["k"], "on", ["id"], [d(2024, 1, 20), d(2024, 2, 20), d(2024, 3, 20)], lag_days=19)
    assert rows(got.select("as_of", "k", "v")) == [(d(2024, 1, 20), "a", 11.0), (d(2024, 2, 20), "a", 12.0), (d(2024, 3, 20), "a", 12.0), (d(2024, 3, 20), "b", 5.0)]
    assert relational.point_in_time(facts.filter("false"), ["k"], "on", ["id"], [d(2024, 1, 1)]).count() == 0


@pytest.mark.parametrize("direction,other,want", [("backward", False, [None, "x", "x", "y"]), ("forward", False, ["x", "x", "y", None]), ("forward", True, ["x", "x", "y", "y"])])
def test_asof_directions(spark, direction, other, want):
    left = spark.createDataFrame([("k", 1), ("k", 2), ("k", 3), ("k", 9)], "k string, t int")
    right = spark.createDataFrame([("k", 2, "x"), ("k", 5, "y"), ("z", 1, "n")], "k string, u int, v string")
    got = relational.asof_join(left, right, ["k"], "t", "u", ["v"], direction, other)
    assert [r.v for r in got.orderBy("t").collect()] == want


def test_upsert_and_insert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k int, v string, batch int")
    assert rows(relational.upsert(old, new, ["k"], "batch")) == [(1, "a"), (2, "d"), (3, "e")]
    assert rows(relational.insert_absent(old, new.filter("batch = 1").drop("batch"), ["k"])) == [(1, "a"), (2, "b"), (3, "e")]


def test_dedupe_keeps_blanks(spark):
    df = spark.createDataFrame([(1, " Big News"), (2, "big news "), (3, ""), (4, None), (5, "  ")], "i int, title string")
    assert [r[0] for r in rows(relational.dedupe_titles(df, "title", ["i"]), "i")] == [1, 3, 4, 5]


def test_turnover_and_costs(spark):
    one = spark.createDataFrame([(1, "a", 0.5), (1, "b", -0.5), (2, "a", 0.5), (2, "b", -0.5), (3, "c", 0.5), (3, "d", -0.5)], "k int, s string, w double")
    got = dict(rows(pf.turnover(pf.book_changes(one, "w", [], "s", "k"), ["k"])))
    assert got == {1: 0.5, 2: 0.0, 3: 1.0, 4: 0.5}
    assert spark.range(1).select(pf.cost_drag(F.lit(1.0), 20), pf.cost_drag(F.lit(1.0), 10)).first() == (0.004, 0.002)


def test_cap_leaves_cash_or_fills(spark):
    few = spark.createDataFrame([(1, i, 0.25) for i in range(4)], "g int, s int, w double")
    assert few.transform(pf.capped, "w", ["g"], 0.05).agg(F.round(F.sum("w"), 9)).first()[0] == 0.2
    many = spark.createDataFrame([(1, i, 0.5 if i == 0 else 0.5 / 39) for i in range(40)], "g int, s int, w double")
    total, most = pf.capped(many, "w", ["g"], 0.05).agg(F.sum("w"), F.max("w")).first()
    assert total == pytest.approx(1) and most <= 0.05 + 1e-9


def test_performance_guards(spark):
    flat = spark.createDataFrame([("f", i, 0.01) for i in range(12)], "s string, t int, r double")
    m = stats.performance(flat, "r", ["s"]).first()
    assert m.ann_return == pytest.approx(1.01**12 - 1) and m.sharpe == 0.0 and m.sortino is None


def test_residuals_match_least_squares(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 3))
    df = spark.createDataFrame([(i, i % 2, *map(float, r)) for i, r in enumerate(x)], "i int, g int, a double, b double, c double")
    got = np.array([r[2:] for r in rows(xs.residualised(df, ["a", "b", "c"], ["g"]), "i")])
    for g in (0, 1):
        own = x[g::2]
        beta, *_ = np.linalg.lstsq(got[g::2, :2], own[:, 2], rcond=None)
        assert np.allclose(got[g::2, 2], own[:, 2] - got[g::2, :2] @ beta)


def test_zscore_small_and_flat_groups(spark):
    df = spark.createDataFrame([("s", 1.0), ("s", 2.0), *[("f", 3.0)] * 6, *[("n", float(i)) for i in range(5)], ("n", None)], "g string, v double")
    got = rows(xs.zscored(df, ["v"], ["g"]))
    assert [v for g, v in got if g in "sf"] == [0.0] * 8
    assert sum(v for g, v in got if g == "n" and v is not None) == pytest.approx(0) and ("n", None) in got


def test_hysteresis_matches_loop(spark):
    rng = np.random.default_rng(1)
    data = [(s, t, bool(c), bool(c or b)) for s in range(6) for t in range(30) if rng.random() > 0.1 for c, b in [(rng.random() < 0.2, rng.random() < 0.6)]]
    got = {(s, t): m for s, t, _, _, m in rows(xs.held_members(spark.createDataFrame(data, "s int, t int, core boolean, band boolean"), "core", "band", ["s"], "t", "m"), "s", "t")}
    last = {}
    for s, t, core, band in sorted(data):
        member = core or (last.get((s, t - 1), False) and band)
        last[s, t] = member
        assert got[s, t] == member


def test_regimes_need_twenty(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(25)], "d int, v double")
    got = rows(ts.regimes(df, "v", "d"), "d")
    assert got[18][2:] == (0.5, "NORMAL") and got[24][2:] == (1.0, "HIGH")


def test_lexicon(spark):
    df = spark.createDataFrame([("Shares BEAT estimates!",), ("",), (None,), ("fraud fraud fraud",)], "t string")
    assert [round(r[0], 4) for r in df.select(text.lexicon_boost(F.col("t"))).collect()] == [0.46, 0.0, 0.0, -0.5]


def test_sentiment_of_no_articles(spark):
    scored = text.scored_headlines(spark.createDataFrame([("a", "record revenue")], "symbol string, title string"))
    out = text.backfilled(text.sentiment_summary(scored, ["symbol"]), spark.createDataFrame([("a",), ("b",)], "symbol string"), "symbol")
    assert dict((r.symbol, (r.article_count, r.sentiment_score == 50.0)) for r in out.collect()) == {"a": (1, False), "b": (0, True)}


def test_ratio_fallbacks(spark):
    facts = [("net_income", 5000.0), ("total_assets", 100000.0), ("total_liabilities", 60000.0), ("total_debt", 20000.0), ("total_revenue", 30000.0), ("operating_cash_flow", 900.0), ("capital_expenditure", -100.0), ("basic_eps", 2.5), ("shares_outstanding", 100.0)]
    df = spark.createDataFrame([("x", f, v) for f, v in facts], "symbol string, field_name string, field_value double")
    wide = ratios.derived(ratios.wide_facts(df, ["symbol"]).withColumn("price", F.lit(25.0)))
    got = {r.field_name: r.field_value for r in ratios.ratio_rows(wide, ["symbol"]).collect()}
    assert got["roe_hist"] == 0.125 and got["debt_to_equity_hist"] == 0.5 and got["pe_ratio_hist"] == 10.0 and got["fcf_margin_hist"] == pytest.approx(800 / 30000, abs=1e-6)
    assert got["fcf_yield_hist"] == pytest.approx(800 / 2500) and "gross_margin_hist" not in got
    assert rows(ratios.free_cash_flow_rows(df, ["symbol"])) == [("x", "free_cash_flow", 800.0)]


def test_parsers(spark, tmp_path):
    lines = spark.createDataFrame([("title",), ("",), ("202401,  1.50, -0.25",), ("202402, 2.00, NaN",), (" Annual Factors",), ("2024, 3, 4",)], "value string")
    assert rows(parsers.factor_csv(lines, ["mkt", "smb"])) == [(dt.date(2024, 1, 31), 0.015, -0.0025), (dt.date(2024, 2, 29), 0.02, None)]
    (tmp_path / "c.csv").write_text("Ticker,Name,Country\n AAPL ,Apple,USAX\nX,, \n")
    got = parsers.static_csv(spark, str(tmp_path / "c.csv"), {"symbol": ["symbol", "ticker"], "security": ["security", "name"], "country": ["country"]})
    assert rows(got) == [("AAPL", "Apple", "USA"), ("X", None, None)]
    facts = spark.createDataFrame([("A", "Revenues", [("2024-03-31", 5.0, "10-Q", "Q1"), ("2023-12-31", 20.0, "10-K", "FY")]), ("A", "SalesRevenueNet", [("2024-03-31", 4.0, "10-Q", "Q1")])], "symbol string, concept string, facts array<struct<end: string, val: double, form: string, fp: string>>")
    got = parsers.filing_facts(facts, [("Revenues", "total_revenue"), ("SalesRevenueNet", "total_revenue")])
    assert rows(got.select("report_date", "period_type", "field_value")) == [(dt.date(2023, 12, 31), "annual", 20.0), (dt.date(2024, 3, 31), "quarterly", 5.0)]
    news = spark.createDataFrame([('{"content": {"title": "A", "pubDate": "2024-01-02T03:04:05Z", "provider": {"displayName": "P"}}}',), ('{"title": "B", "publisher": "Q", "providerPublishTime": 1704067200}',), ('{"title": "[Removed]"}',)], "value string")
    assert rows(parsers.news_feed(news).select("title", "publisher", "published")) == [("A", "P", dt.datetime(2024, 1, 2, 3, 4, 5)), ("B", "Q", dt.datetime(2024, 1, 1))]


def test_quality(spark):
    p = spark.createDataFrame([(1.0, 2.0, 1.0, 5), (None, 1.0, 2.0, -1)], "close double, high double, low double, volume long")
    assert quality.price_quality(p, "close", "high", "low", "volume").first() == (2, 1, 1, 1)
    assert [r[1:3] for r in rows(quality.swapped_high_low(p, "high", "low"), "volume")] == [(2.0, 1.0), (2.0, 1.0)]
    assert quality.content_print(p, p.columns).first() == quality.content_print(p.orderBy("volume"), p.columns).first()


def test_islands_and_drawdown(spark):
    s = spark.createDataFrame([("x", i, v) for i, v in enumerate([0.1, -0.5, 0.2, 1.5])], "k string, t int, r double")
    assert [round(r.drawdown, 6) for r in ts.drawdowns(s, "r", ["k"], "t").orderBy("t").collect()] == [0.0, -0.5, -0.4, 0.0]
    lab = spark.createDataFrame([("x", i, v) for i, v in enumerate("aabba")], "k string, t int, v string")
    assert rows(ts.islands(lab, "v", ["k"], "t"), "start") == [("x", "a", 0, 1, 2), ("x", "b", 2, 3, 2), ("x", "a", 4, 4, 1)]


def test_sharpe_probabilities(spark):
    zero, half = F.lit(0.0), F.lit(0.5)
    psr = spark.range(1).select(stats.probabilistic_sharpe(half, 0.5, F.lit(60), zero, F.lit(3.0)).alias("even"), stats.probabilistic_sharpe(F.lit(1.0), 0.0, F.lit(5), zero, zero).alias("short")).first()
    assert psr.even == pytest.approx(0.5) and psr.short is None
    assert stats.minimum_backtest_length(0.0) == math.inf
    z = [-9.0, -6.5, -2.0, -1e-9, 0.0, 0.3, 1.96, 4.0, 6.9, 8.0]
    # the alias hides the column for whatever comes later in the same select
    got = spark.createDataFrame([(x,) for x in z], "z double").select((F.col("z") * 0).alias("z"), stats.normal_cdf(F.col("z")).alias("p")).collect()
    assert [r.p for r in got] == pytest.approx([NormalDist().cdf(x) for x in z], abs=1e-10)


def test_paths_differ_beyond_the_series_length(spark):
    series = spark.createDataFrame([("a", i, 0.01 * (i % 7) - 0.02) for i in range(24)], "s string, i int, r double")
    paths = stats.monte_carlo_paths(series, "r", ["s"], "i", block=3, paths=200).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("step", F.round("nav", 9)))).alias("navs"))
    assert paths.select("navs").distinct().count() == 200


@pytest.mark.parametrize(("n", "groups", "purge", "embargo"), [(25, 4, 2, 1), (83, 12, 2, 1), (10, 3, 0, 0), (7, 3, 1, 2)])
def test_cpcv_splits(spark, n, groups, purge, embargo):
    got = stats.cpcv_splits(spark.range(n).select(F.col("id").cast("int").alias("i")), "i", groups, purge, embargo).collect()
    edges = [g * n // groups for g in range(groups + 1)]
    for r in got:
        held = {j for g in (r.g1, r.g2) for j in range(edges[g], edges[g + 1])}
        out = {j for g in (r.g1, r.g2) for j in (*range(edges[g] - purge, edges[g]), *range(edges[g + 1], edges[g + 1] + purge + embargo))}
        assert r.role == ("test" if r.i in held else "left_out" if r.i in out else "train")
    assert len(got) == n * groups * (groups - 1) // 2


def test_stream_round_trip(spark, tmp_path):
    rows_ = spark.createDataFrame([(1, "a", 2.0), (2, "b", 3.0)], "id int, name string, v double")
    events.keyed_messages(rows_, "id").unionByName(spark.createDataFrame([("9", "not json")], "key string, value string")).write.parquet(str(tmp_path / "in"))
    got = []
    stream = events.decoded(events.read_messages(spark, str(tmp_path / "in")), "id int, name string, v double").filter("id is not null")
    for _ in range(2):  # the second run finds nothing new
        events.consume(stream, lambda df, _: got.extend(df.collect()), str(tmp_path / "checkpoint")).awaitTermination()
    assert sorted(tuple(r) for r in got) == [("1", 1, "a", 2.0), ("2", 2, "b", 3.0)]


def test_flat_groups_have_no_correlation(spark):
    rows = [("flat", float(i), 1.0) for i in range(6)] + [("both", float(i), 2.0 * i + (i == 3)) for i in range(6)] + [("gap", 1.0, float(i)) for i in range(6)] + [("gap", None, 7.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = {r.g: r.c for r in df.groupBy("g").agg(scalars.guarded_corr("x", "y").alias("c")).collect()}
    assert got["flat"] is None and got["gap"] is None and abs(got["both"] - df.filter("g = 'both'").corr("x", "y")) < 1e-12
    ic = {r.g: (r.ic_spearman, r.ic_pearson, r.n) for r in xs.information_coefficient(df, ["x"], "y", ["g"]).collect()}
    assert ic["flat"] == (None, None, 6) and ic["gap"] == (None, None, 6) and ic["both"][0] == 1.0


def test_growth_against_the_report_before(spark):
    facts = [("A", "2024-03-31", "diluted_eps", 2.0), ("A", "2024-06-30", "basic_eps", 2.5), ("A", "2024-03-31", "total_revenue", 0.0), ("A", "2024-06-30", "total_revenue", 5.0)]
    facts += [("A", "2024-03-31", "net_income", -10.0), ("A", "2024-06-30", "net_income", 5.0), ("A", "2024-03-31", "operating_cash_flow", 0.01), ("A", "2024-06-30", "operating_cash_flow", 9.0), ("A", "2024-06-30", "operating_income", 3.0)]
    df = spark.createDataFrame(facts, "symbol string, report_date string, field_name string, field_value double")
    wide = ratios.derived(ratios.wide_facts(df, ["symbol", "report_date"]).withColumn("price", F.lit(25.0)))
    assert {(r.field_name, r.field_value) for r in ratios.growth_rows(wide, ["symbol"], "report_date").collect()} == {("earnings_growth_hist", 0.25), ("net_income_growth_hist", 1.5)}
    names = {r.field_name for r in ratios.ratio_rows(wide, ["symbol", "report_date"]).filter("report_date = '2024-06-30'").collect()}
    assert "operating_margin_hist" in names and not names & {"ebitda_margin_hist", "ev_to_ebitda_hist"}


# regression on any number of columns


def _plain_hac(x, y, lags):
    """Coefficients and Newey-West errors by matrix algebra."""
    x = np.column_stack([np.ones(len(y)), x])
    inv = np.linalg.inv(x.T @ x)
    beta = inv @ x.T @ y
    u = x * (y - x @ beta)[:, None]
    meat = u.T @ u
    for lag in range(1, lags + 1):
        g = u[lag:].T @ u[:-lag]
        meat += (1 - lag / (lags + 1)) * (g + g.T)
    return beta, np.sqrt(np.diag(inv @ meat @ inv)), 1 - ((y - x @ beta) ** 2).sum() / ((y - y.mean()) ** 2).sum()


@pytest.mark.parametrize("k", [1, 4, 6])
def test_hac_fit_matches_matrix_algebra(spark, k):
    rng = np.random.default_rng(k)
    rows, want = [], {}
    for s in ("p", "q"):
        x = rng.normal(size=(60, k)) * np.logspace(-3, 2, k)
        y = 0.01 + x @ rng.normal(size=k) + np.cumsum(rng.normal(size=60)) * 0.1
        want[s] = _plain_hac(x, y, 4)
        rows += [(s, t, float(y[t]), *map(float, x[t])) for t in range(60)]
        rows += [(s, 30, None, *map(float, x[0])), (s, 31, float("nan"), *map(float, x[0]))]  # left out
    names = [f"x{i}" for i in range(k)]
    df = spark.createDataFrame(rows + [("short", t, 1.0 * t, *[0.5 * t] * k) for t in range(5)], f"s string, t int, y double, {', '.join(f'{n} double' for n in names)}")
    got = regression.hac_fit(df, names, "y", ["s"], "t").collect()
    assert {r.s for r in got} == {"p", "q"}
    for r in got:
        beta, se, r2 = want[r.s]
        i = (["alpha", *names]).index(r.factor)
        assert r.beta == pytest.approx(beta[i], rel=1e-6) and r.se == pytest.approx(se[i], rel=1e-6) and r.r_squared == pytest.approx(r2, rel=1e-8)
        assert r.t == pytest.approx(beta[i] / se[i], rel=1e-6) and r.n == 60
        assert r.low == pytest.approx(beta[i] - 1.96 * se[i], rel=1e-5, abs=1e-9)


def test_hac_fit_of_dependent_or_constant_columns_has_no_slopes(spark):
    rows = [("a", t, float(t % 7), float(t), 2.0 * t) for t in range(40)] + [("b", t, float(t % 5), float(t), 3.0) for t in range(40)]
    df = spark.createDataFrame(rows, "s string, t int, y double, x double, z double")
    got = regression.hac_fit(df, ["x", "z"], "y", ["s"], "t").collect()
    assert len(got) == 6 and all(r.beta is None and r.t is None for r in got)
    assert regression.hac_fit(df.filter("false"), ["x", "z"], "y", ["s"], "t").count() == 0


@pytest.mark.parametrize("k", [2, 3, 4])
def test_cross_section_fit_finds_the_slopes(spark, k):
    rng = np.random.default_rng(k)
    slopes, rows = np.linspace(0.5, -0.3, k), []
    for day in range(3):
        x = rng.normal(size=(300, k))
        y = x @ slopes + 0.1 * rng.normal(size=300)
        rows += [(day, float(y[i]), *map(float, x[i])) for i in range(300)]
    names = [f"x{i}" for i in range(k)]
    got = regression.cross_section_fit(spark.createDataFrame(rows, f"d int, y double, {', '.join(f'{n} double' for n in names)}"), names, "y", ["d"]).collect()
    for r in got:
        x = np.array([row[2:] for row in rows if row[0] == r.d])
        y = np.array([row[1] for row in rows if row[0] == r.d])
        beta, left, *_ = np.linalg.lstsq(x, y, rcond=None)
        t = beta / np.sqrt(left[0] / (300 - k) * np.diag(np.linalg.inv(x.T @ x)))
        for i, n in enumerate(names):
            assert r[f"beta_{n}"] == pytest.approx(beta[i]) and r[f"t_{n}"] == pytest.approx(t[i])
            assert abs(r[f"beta_{n}"] - slopes[i]) < 0.1
        assert r.r_squared == pytest.approx(1 - left[0] / ((y - y.mean()) ** 2).sum())


def test_month_end_join(spark):
    five = spark.createDataFrame([(202401, 1.5), (202402, -2.0), (202404, 1.0)], "ym int, mkt double")
    mom = spark.createDataFrame([("2024-01-31", 3.0), ("2024-02-01", 4.0), ("2024-03-15", 5.0)], "d string, mom double").withColumn("d", F.to_date("d"))
    got = regression.month_end_join(five, mom, "d").orderBy("month_end").collect()
    assert [(str(r.month_end), r.mkt, r.mom) for r in got] == [("2024-01-31", pytest.approx(0.015), pytest.approx(0.03)), ("2024-02-29", pytest.approx(-0.02), pytest.approx(0.04))]
