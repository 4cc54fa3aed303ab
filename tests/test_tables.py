"""Versioned tables: nothing between before and after, repeated batches, conflicts, rejects."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from hygroflow.session import Files, Scope
from hygroflow.sources import snapshot
from hygroflow.sources.tables import Conflict, Tables
from hygroflow.streaming import incremental as inc


@pytest.fixture
def tables(spark, tmp_path):
    return Tables(spark, str(tmp_path / "root"))


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_replace_extend_and_scan(spark, tables):
    assert tables.version("t") is None
    with pytest.raises(LookupError):
        tables.scan("t")
    first = tables.replace("t", spark.range(3).select("id", F.lit("x").alias("a b")))
    old = tables.scan("t")
    assert first.rows == 3 and tables.scan("t", "a b").columns == ["a b"]
    tables.extend("t", lambda state: state.where("id > 0").withColumn("id", F.col("id") + 10))
    assert [r["id"] for r in tables.scan("t").orderBy("id").collect()] == [0, 1, 2, 11, 12]
    tables.replace("t", spark.range(1))
    assert tables.scan("t").columns == ["id"] and tables.version("t").number == 3
    assert old.count() == 3  # a frame keeps its version
    with pytest.raises(ValueError):
        tables.extend("t", lambda state: state.withColumn("more", F.lit(1)))
    tables.replace("t", spark.range(0))
    assert tables.scan("t").count() == 0


def test_writer_lost_before_the_switch(spark, tables, monkeypatch):
    frames = {"one": spark.range(5), "two": spark.range(7)}
    snapshot.copy_tables(tables, frames)
    with monkeypatch.context() as lost:
        lost.setattr(Tables, "_switch", lambda *_: (_ for _ in ()).throw(SystemError("lost")))
        with pytest.raises(SystemError):
            snapshot.copy_tables(tables, {"one": spark.range(50)})
    assert tables.scan("one").count() == 5 and tables.version("one").number == 1
    assert tables.clean("one") == []  # still young
    assert len(tables.clean("one", older_than_s=-1)) == 1
    assert snapshot.copy_tables(tables, {"one": spark.range(50)}) == {"one": 50}
    got = rows(snapshot.snapshot_counts({"one": spark.range(50), "two": spark.range(7)}, tables))
    assert got == [("one", 50, 50, 90), ("two", 7, 7, 7)]


def test_writer_lost_while_writing(spark, tables):
    tables.replace("t", spark.range(4))
    broken = spark.range(100, numPartitions=4).select(F.when(F.col("id") == 99, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="lost"):
        tables.replace("t", broken)
    assert [r["id"] for r in tables.scan("t").orderBy("id").collect()] == [0, 1, 2, 3]


def test_a_batch_counts_once_per_source(spark, tables):
    for source, batch in (("a", 0), ("a", 0), ("b", 0), ("a", 2), ("a", 1)):
        tables.extend("t", lambda _: spark.range(1), source, batch)
    version = tables.version("t")
    assert version.rows == 3 and version.ledger == {"a": 2, "b": 0}
    assert tables.compact("t").ledger == {"a": 2, "b": 0} and len(tables.version("t").parts) == 1
    assert tables.scan("t").count() == 3


def test_of_two_writers_the_second_starts_again(spark, tables):
    tables.replace("t", spark.range(2))
    states = []

    def slow(state):
        states.append(state.count())
        if len(states) == 1:  # another job gets in between
            tables.extend("t", lambda _: spark.range(10))
        return state.agg(F.count(F.lit(1)).alias("id"))

    tables.extend("t", slow)
    assert states == [2, 12] and tables.scan("t").agg(F.max("id")).first()[0] == 12
    version = tables.version("t")
    with pytest.raises(Conflict):
        tables._switch("t", version)


# -- weather and executions -----------------------------------------------------
PAYLOAD = (
    "start timestamp_ntz, end timestamp_ntz, step_s int, temperature_2m array<double>, relative_humidity_2m array<double>,"
    " rain array<double>, surface_pressure array<double>, wind_speed_10m array<double>"
)


def payload(spark, *days):
    """Per day: number of hours of the axis and of the arrays."""
    values = []
    for day, (axis, n) in enumerate(days, 1):
        array = f"transform(sequence(1, {n}), x -> cast(x AS double))" if n else "cast(NULL AS array<double>)"
        values.append(
            f"SELECT timestamp_ntz'2024-01-{day:02d} 00:00:00' AS start, timestamp_ntz'2024-01-{day:02d} {axis:02d}:00:00' AS end,"
            f" 3600 AS step_s, {array} AS temperature_2m, {array} AS relative_humidity_2m, {array} AS rain,"
            f" {array} AS surface_pressure, {array} AS wind_speed_10m"
        )
    return spark.sql(" UNION ALL ".join(values))


def test_rejected_positions(spark):
    df = payload(spark, (3, 3), (3, 5), (0, 2), (4, 2), (2, 0))
    assert inc.explode_payload(df).count() == 3 + 3 + 0 + 4 + 2
    got = rows(inc.payload_rejects(df).select(F.dayofmonth("start"), "position", "reason", "rain"))
    assert got == [(2, 3, "beyond the axis", 4.0), (2, 4, "beyond the axis", 5.0), (3, 0, "no axis", 1.0), (3, 1, "no axis", 2.0)]
    counts = rows(inc.reject_counts(inc.payload_rejects(df)).select(F.dayofmonth("start"), "n_rejected", "n_with_value", "first_position"))
    assert counts == [(2, 2, 2, 3), (3, 2, 2, 0)]
    lost = df.withColumn("step_s", F.lit(None).cast("int"))
    assert inc.explode_payload(lost).count() == 0 and inc.payload_rejects(lost).count() == 12


def test_weather_stream_run_twice(spark, tables, tmp_path):
    landed = str(tmp_path / "landed")
    payload(spark, (3, 3), (3, 5)).write.parquet(landed)
    payload(spark, (3, 3), (2, 2)).write.mode("append").parquet(landed)  # day 1 again
    schema = spark.read.parquet(landed).schema

    def run(checkpoint):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(landed)
        load = lambda df, i: inc.load_weather(tables, df, "landed", i)
        query = stream.writeStream.foreachBatch(load).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start()
        query.awaitTermination()

    run("c1")
    state = rows(tables.scan("weather_hourly"))
    assert len({r[0] for r in state}) == len(state) == 6 and tables.scan("weather_hourly_rejects").count() == 2
    run("c2")  # the checkpoint is lost: every batch comes again
    assert rows(tables.scan("weather_hourly")) == state and tables.scan("weather_hourly_rejects").count() == 2


def test_executions_as_one_step(spark, tables, monkeypatch):
    calendar = spark.createDataFrame(
        [(1, "2024-01-01 10:00:00", 30, 1), (2, "2024-01-01 11:00:00", 30, 0)],
        "execution_id bigint, start_time string, execution_time bigint, executed bigint",
    )
    schedule = spark.createDataFrame([(1, 45)], "schedule_id bigint, execution_time bigint")
    data = spark.createDataFrame([(1, "2024-01-02 10:00:00")], "schedule_id bigint, last_execution string")
    known = spark.createDataFrame(
        [("c-0", "calendar", None, 5)], "execution_id string, _source string, start_time timestamp_ntz, runtime bigint"
    )
    tables.replace("all_executions", known)
    with monkeypatch.context() as lost:
        lost.setattr(Tables, "_switch", lambda *_: (_ for _ in ()).throw(SystemError("lost")))
        with pytest.raises(SystemError):
            inc.load_executions(tables, calendar, data, schedule)
    assert tables.scan("all_executions").count() == 1
    for _ in range(2):
        inc.load_executions(tables, calendar, data, schedule)
    got = tables.scan("all_executions").collect()
    assert len(got) == 3 and len({r["execution_id"] for r in got}) == 3


def test_scope_computes_once_and_leaves_nothing(spark):
    calls = []
    with Scope(spark) as scope:
        build = lambda: calls.append(1) or spark.range(3)
        assert scope.table("t", build).count() == scope.table("t", build).count() == 3
        folder = scope.folder
        assert Files(spark).names(folder) == ["t"]
    assert calls == [1] and Files(spark).names(folder) == []
