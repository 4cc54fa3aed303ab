"""Logs laid out by day: windows open their days only, rejects and repeated batches."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from hygroflow.sources import daily
from hygroflow.sources.tables import Tables

SCHEMA = "id long, at string, day int, v string"


@pytest.fixture
def tables(spark, tmp_path):
    return Tables(spark, str(tmp_path / "root"))


def log(spark, first, n, every_hours=6):
    rows = spark.range(first, first + n).withColumn("t", F.expr(f"timestamp_ntz'2024-03-01' + make_interval(0, 0, 0, 0, id * {every_hours})"))
    return rows.select("id", F.col("t").cast("string").alias("at"), F.lit(1).alias("day"), F.lit("x").alias("v"))


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_window_opens_its_days(spark, tables):
    daily.load(tables, "log", log(spark, 0, 40), "at", batch=0)
    daily.load(tables, "log", log(spark, 40, 40), "at", batch=1)
    stored = tables.scan("log")
    assert stored.columns == ["id", "v", "ts", "day"] and len(tables.version("log").parts) == 2
    window = daily.between(stored, "2024-03-02 06:00:00", "2024-03-04")
    assert ids(window) == [5, 6, 7, 8, 9, 10, 11]
    assert "(day#" in plan(window).split("PartitionFilters: ")[1].split("]")[0]
    days = {r[0] for r in window.select(F.to_date("ts")).collect()}
    opened = window.select(F.input_file_name().alias("f")).distinct().collect()
    assert {f"day={d}" for d in days} == {r["f"].split("/")[-2] for r in opened}
    assert ids(daily.between(stored, "2024-03-20 12:00:00")) == [78, 79]
    assert ids(daily.between(stored, "2024-03-01", "2024-03-01 00:00:01")) == [0]
    assert ids(daily.between(stored, "2024-03-02", "2024-03-02")) == []


def test_days_of_events_prune_the_scan(spark, tables):
    daily.load(tables, "log", log(spark, 0, 40), "at")
    events = daily.timed(log(spark, 0, 40, 24), "at").where("id IN (1, 3)")
    on_days = daily.on_days_of(tables.scan("log"), events)
    assert ids(on_days) == [4, 5, 6, 7, 12, 13, 14, 15]
    tables.replace("events", events)
    assert "dynamicpruning" in plan(daily.on_days_of(tables.scan("log"), tables.scan("events").where("id > 2"))).lower()


def test_rejects_and_repeated_batches(spark, tables):
    rows = [(1, "2024-03-01 00:00:00", 5, "a"), (2, "no time", 5, "b"), (3, None, None, None), (4, "2024-03-01 23:59:59.5", 1, "c")]
    rows += [(1, "2024-03-01 00:00:00", 5, "a"), (5, "", 1, "")]
    frame = spark.createDataFrame(rows, SCHEMA)
    for _ in range(2):
        daily.load(tables, "log", frame, "at", batch=7)
    assert ids(tables.scan("log")) == [1, 1, 4]
    assert ids(tables.scan(daily.rejects_of("log"))) == [2, 3, 5]
    assert tables.scan(daily.rejects_of("log")).columns == frame.columns
    daily.load(tables, "log", frame.limit(0), "at", batch=8)
    assert ids(tables.scan("log")) == [1, 1, 4]


def test_rejects_alone_are_brought_by_the_repeated_batch(spark, tables, monkeypatch):
    frame = spark.createDataFrame([(1, "2024-03-01", 1, "a"), (2, "?", 1, "b")], SCHEMA)
    switch = Tables._switch

    def lost(self, name, version):
        if name == "log":
            raise SystemError("lost")
        switch(self, name, version)

    with monkeypatch.context() as m:
        m.setattr(Tables, "_switch", lost)
        with pytest.raises(SystemError):
            daily.load(tables, "log", frame, "at", batch=0)
    assert tables.version("log") is None
    daily.load(tables, "log", frame, "at", batch=0)
    assert ids(tables.scan("log")) == [1] and ids(tables.scan(daily.rejects_of("log"))) == [2]


def test_layout_survives_replace_and_compact(spark, tables):
    rows = spark.range(9).select((F.col("id") % 3).alias("k"), F.when(F.col("id") > 0, F.col("id")).alias("g"), F.col("id").alias("v"))
    tables.replace("t", rows, by=("k", "g"))
    tables.extend("t", lambda state: state.select("k", "g", (F.col("v") + 100).alias("v")))
    got = sorted(map(tuple, tables.scan("t").collect()), key=str)
    assert tables.scan("t").columns == ["k", "g", "v"] and len(got) == 18
    tables.compact("t")
    assert sorted(map(tuple, tables.scan("t").collect()), key=str) == got
    assert tables.version("t").by == ("k", "g") and len(tables.version("t").parts) == 1
    assert len(tables.clean("t", older_than_s=-1)) == 2
    assert tables.replace("t", spark.range(2)).by == ()
