"""The panel of scores: one pass over lineitem, and steps against the joins that they stand for."""

import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.operators import factors
from marlstone.operators import timeseries as ts
from marlstone.plans import queries, views

D = dt.date
SF = "/root/testdata/sf0.001"


def _table(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_scores_read_lineitem_once(spark, monkeypatch):
    read, load = [], views.load
    for module in (views, queries):
        monkeypatch.setattr(module, "load", lambda spark, sf_dir, name: read.append(name) or load(spark, sf_dir, name))
    queries._scores(spark, SF)
    assert read.count("lineitem") == 1


def test_views_from_quarterly_sums(spark):
    sums = views.quarterly_sums(spark, SF)
    assert _table(views.prices_of(sums)) == _table(views.prices(spark, SF))
    for f in (views.ratio_facts, views.statement_facts, views.sentiment_facts):
        assert _table(f(spark, SF, sums)) == _table(f(spark, SF))


def test_padded_panel_is_the_grid_carried_forward(spark):
    rng = random.Random(3)
    rows = [(s, D(2020 + k // 12, k % 12 + 1, 1), rng.choice([None, 1.0, 2.0]), float(k)) for s in (1, 2, 3, None) for k in range(20) if rng.random() < 0.4]
    rows += [(4, None, 5.0, 1.0), (5, None, 6.0, 1.0), (5, D(2020, 1, 1), 7.0, 2.0), (6, D(2021, 8, 1), 8.0, 3.0)]
    df = spark.createDataFrame(rows, "symbol int, month date, px double, volume double")
    want = ts.padded(ts.month_panel(df), "px", ["symbol"], "month")
    assert _table(ts.padded_panel(df, "px")) == _table(want)
    assert ts.padded_panel(df.limit(0), "px").count() == 0


def test_known_fields_are_those_of_the_lookup(spark):
    rng = random.Random(4)
    day = lambda: D(2020, 1, 1) + dt.timedelta(days=rng.randint(0, 500))

    def facts(fields, on):
        rows = {(s, day(), f): rng.random() for s in "abc" for f in fields for _ in range(6)} | {("a", D(2020, 4, 17), fields[0]): 0.5}
        return spark.createDataFrame([(*k, v) for k, v in rows.items()], f"symbol string, {on} date, field_name string, field_value double")

    ratios, statements = facts(["roe_hist", "book_to_price"], "snapshot_date"), facts(["net_income", "total_debt"], "report_date")
    mood = spark.createDataFrame([(s, d, v) for (s, d), v in {(s, day()): rng.random() for s in "ab" for _ in range(6)}.items()], "symbol string, day date, score double")
    months = [D(2020 + k // 12, k % 12 + 1, 1) for k in range(20)]
    prices = spark.createDataFrame([(s, m, 1.0) for s in "abcd" for m in months], "symbol string, month date, px double")
    last, keys = spark.createDataFrame([(months[-1],)], "m date"), ["symbol", "month"]
    for lag in (0, 45):
        want = prices
        for df, on, fields in ((ratios, "snapshot_date", factors.RATIO_FIELDS), (statements, "report_date", factors.STATEMENT_FIELDS)):
            want = want.join(factors.wide(factors.monthly_point_in_time(df, ["symbol", "field_name"], on, last, "month", lag), keys, fields), keys, "left")
        want = want.join(factors.monthly_point_in_time(mood, ["symbol"], "day", last, "month", lag).select(*keys, F.col("score").alias("sentiment")), keys, "left")
        moved = mood.withColumn("day", F.date_add("day", lag))
        assert _table(factors.known_then(prices, ratios, statements, moved, lag)) == _table(want)


def test_sources_are_those_of_the_window(spark):
    rows = [(1, "a", None, 2.0, 9.0), (1, "b", None, None, 9.0), (2, "a", 1.0, 2.0, 9.0), (2, "b", None, 2.0, 9.0), (3, "a", None, None, None)]
    df = spark.createDataFrame(rows, "m int, s string, x double, y double, z double")
    cells = [F.col("x"), F.col("y") + 1, F.col("z")]
    assert _table(factors.available(df, {"v": cells}, ["m"])) == _table(df.withColumn("v", factors.first_available(cells, ["m"])))


def _trades(spark, folder):
    """lineitem with gaps, a late first quarter, rows without a date or a supplier, and a supplier that has nothing else."""
    rng = random.Random(5)
    at = lambda: dt.datetime(1995, 2, 1) + dt.timedelta(days=rng.randint(0, 1500))
    rows = [(s, at()) for s in (1, 2, 3, 5, None) for _ in range(25)] + [(4, dt.datetime(1996, 11, 5)), (4, None), (6, None)]
    rows = [(s, d, float(rng.randint(1, 50)), rng.randint(100, 9999) / 4, rng.randint(0, 10) / 128, rng.randint(0, 8) / 128, rng.choice("ARN")) for s, d in rows]
    df = spark.createDataFrame(rows, "l_suppkey long, l_shipdate timestamp, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string")
    df.write.parquet(f"{folder}/lineitem.parquet")


def test_months_from_quarters_are_those_of_the_steps(spark, tmp_path):
    _trades(spark, tmp_path)
    sums = views.quarterly_sums(spark, str(tmp_path))
    panel, w = ts.padded_panel(views.prices(spark, str(tmp_path)), "px"), Window.partitionBy("symbol").orderBy("month")
    sides = {"before": F.lag("px", 1).over(w), "year_ago": F.lag("px", 12).over(w), "ahead": F.lead("px", 1).over(w)}
    prices = panel.select("symbol", "month", "px").withColumns(sides)
    dated = sums.filter("quarter is not null")  # what has no date is never known
    fields = [*views._ratio_cells(), *views._statement_cells()]
    for lag in (0, 45, 90):
        facts = (f(spark, str(tmp_path), dated) for f in (views.ratio_facts, views.statement_facts, views.sentiment_facts))
        want = factors.known_then(prices, *facts, lag).select(*prices.columns, "sentiment", *fields)
        got = views.known_months(sums, lag)
        assert got.columns == want.columns and want.count() > 250
        assert _table(got) == _table(want)
    assert views.known_months(sums.limit(0)).count() == 0


def test_panel_is_shuffled_by_symbol_once_and_sums_are_made_after_the_shuffle(spark):
    def plan(df):
        return df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))

    sums = views.quarterly_sums(spark, SF)
    assert plan(sums).count("Exchange") == 1
    assert plan(sums).index("partial_sum") < plan(sums).index("Exchange")  # printed from the top: the shuffle is below
    known = plan(views.known_months(queries.checkpointed(sums)))
    assert known.count("Exchange") == 1 and "Join" not in known and "Union" not in known
