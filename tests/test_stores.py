"""Incremental loads under retries, and the archive of documents."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.sources import archive
from marlstone.streaming import incremental
from marlstone.streaming.incremental import IncrementalStore, date_range, latest_facts, run_metrics

D = dt.date
SCHEMA = T.StructType([T.StructField("k", T.LongType()), T.StructField("source", T.StringType()), T.StructField("day", T.DateType()), T.StructField("v", T.DoubleType())])


def test_date_range():
    end = D(2024, 6, 30)
    assert date_range(end, "daily") == (D(2024, 6, 25), end) and date_range(end, "quarterly")[0] == D(2024, 3, 27) and date_range(end, years=1) == (D(2023, 7, 1), end)


def _put(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/input")


def good():
    return F.col("v").isNotNull()


def test_runs_take_each_row_once_and_late_rows_by_the_watermark(spark, tmp_path):
    folder = str(tmp_path)
    store = IncrementalStore(spark, f"{folder}/store", SCHEMA, ["source"], "day")
    assert store.facts() is None and store.watermarks() is None
    _put(spark, folder, [(1, "a", D(2024, 1, 1), 1.0), (2, "a", D(2024, 1, 20), 2.0), (3, "b", D(2024, 1, 3), None)])
    store.run(f"{folder}/input", good)
    store.run(f"{folder}/input", good)  # nothing new
    assert store.facts().count() == 2
    _put(spark, folder, [(2, "a", D(2024, 1, 20), 9.0), (4, "a", D(2024, 1, 14), 1.0), (5, "a", D(2024, 1, 15), 1.0), (6, "b", D(2020, 1, 1), 1.0), (7, None, D(2024, 1, 1), 3.0)])
    store.run(f"{folder}/input", good)
    facts = {(r.k, r.v) for r in latest_facts(store.facts(), ["k"]).collect()}
    assert facts == {(1, 1.0), (2, 9.0), (5, 1.0), (6, 1.0), (7, 3.0)}  # 4 is older than the watermark less five days
    marks = {r.source: r.last_success for r in store.watermarks().collect()}
    assert marks == {"a": D(2024, 1, 20), "b": D(2020, 1, 1), None: D(2024, 1, 1)}
    got = {r.source: (r.loaded, r.skipped, r.failed, r.pct_loaded) for r in run_metrics(store.log(), ["source"]).collect()}
    assert got == {"a": (4, 1, 0, 80.0), "b": (1, 0, 1, 50.0), None: (1, 0, 0, 100.0)}
    failed = store.log().filter("status = 'FAILED'").first()
    assert failed.error_message.startswith("invalid row: ") and failed.run_frequency == "daily" and failed.run_id == "0"


def test_a_run_that_fails_half_way_is_repeated_without_double_rows(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)
    store = IncrementalStore(spark, f"{folder}/store", SCHEMA, ["source"], "day")
    _put(spark, folder, [(i, "a", D(2024, 1, 1 + i), float(i)) for i in range(5)])
    write, calls = IncrementalStore._write, []

    def breaking(self, df, name, batch):
        write(self, df, name, batch)
        calls.append(name)
        if name == "log" and calls.count("log") == 1:
            raise RuntimeError("lost")

    monkeypatch.setattr(IncrementalStore, "_write", breaking)
    with pytest.raises(Exception, match="lost"):
        store.run(f"{folder}/input", good)
    assert store.facts().count() == 5 and store.watermarks() is None
    _put(spark, folder, [(9, "a", D(2024, 2, 1), 9.0)])
    store.run(f"{folder}/input", good)
    assert sorted(r.k for r in store.facts().collect()) == [0, 1, 2, 3, 4, 9]
    assert run_metrics(store.log(), ["source"]).first().loaded == 6 and calls.count("facts") == 3
    assert store.watermarks().first().last_success == D(2024, 2, 1)


def test_long_errors_are_cut(spark):
    rows = spark.createDataFrame([("a", D(2024, 1, 1))], "source string, day date")
    log = incremental.log_rows(rows, "r1", "weekly", ["source"], F.lit("FAILED"), F.lit("e" * 2000), "day").first()
    assert len(log.error_message) == 500 and log.run_id == "r1" and log.rows_affected == 1


# archive


def test_sanitised(spark):
    texts = ['{"a": NaN, "b": [-Infinity, 1], "c": "NaN, \\"Infinity", "NaN": Infinity}', "NaN", '{"a": 1}', None, '{"open": "x', ""]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(archive.sanitised("t")).collect()]
    assert json.loads(got[0]) == {"a": None, "b": [None, 1], "c": 'NaN, "Infinity', "NaN": None}
    assert got[1:4] == ["null", '{"a": 1}', None] and got[5] == ""


def test_find_by_paths(spark, tmp_path):
    path = str(tmp_path / "archive")
    docs = [{"n": 1, "who": {"name": "x", "tags": ["p", "q"]}}, {"n": 2.5, "who": {"name": "y"}}, {"n": "3", "who": None}, {"m": 1, "ok": True}]
    texts = [json.dumps(d) for d in docs] + ["no json", '{"n": NaN, "big": 1e400}', "[1, 2]", '"text"', None]
    archive.insert(spark.createDataFrame([(i, t) for i, t in enumerate(texts[:4])], "i int, value string"), path)
    archive.insert(spark.createDataFrame([(i + 4, t) for i, t in enumerate(texts[4:])], "i int, value string"), path)
    ids = lambda q, limit=0: sorted(r.i for r in archive.find(spark, path, q, limit).collect())
    assert ids({"n": 1}) == [0] and ids({"n": {"$gt": 1, "$lte": 2.5}}) == [1] and ids({"n": "3"}) == [2] and ids({"who.name": {"$in": ["x", "y"]}}) == [0, 1]
    assert ids({"who.tags[1]": "q"}) == [0] and ids({"ok": True}) == [3] and ids({"who.name": {"$exists": True}}) == [0, 1]
    assert 0 not in ids({"n": {"$ne": 1}}) and {1, 3, 5, 6} <= set(ids({"n": {"$ne": 1}}))
    assert len(ids({})) == len(ids({}, limit=100)) and len(ids({}, limit=2)) == 2
    rejected = {r.i: r.rejected for r in spark.read.parquet(path).filter("rejected IS NOT NULL").collect()}
    assert rejected[4] == "no json" and set(rejected) <= {4, 5}
    with pytest.raises(ValueError, match="operator"):
        archive.condition({"n": {"$near": 1}})
