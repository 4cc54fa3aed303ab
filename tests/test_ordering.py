from __future__ import annotations

from pyspark.sql import functions as F

from hygroflow.operators import ordering
from hygroflow.operators.ordering import positioned
from hygroflow.session import stored


def test_positions_follow_the_order_over_many_ranges(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 1000).alias("k"), "id").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = positioned(rows, [F.col("k").desc(), F.col("id").asc()]).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = sorted(((r["k"], r["id"]) for r in got), key=lambda r: (-r[0], r[1]))
    assert [(r["k"], r["id"]) for r in sorted(got, key=lambda r: r["position"])] == want
    assert sorted(r["position"] for r in got) == list(range(1, 5001))


def test_equal_rows_are_spread_and_nulls_placed(spark, monkeypatch):
    rows = spark.range(4000).select(F.when(F.col("id") % 4 == 0, F.col("id")).alias("k"), F.lit(9).alias("position"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tables = []
        monkeypatch.setattr(ordering, "stored", lambda df, label: tables.append(stored(df, label)) or tables[-1])
        got = positioned(rows, [F.col("k").asc_nulls_first()])
        ranges = tables[0].groupBy(F.shiftright(ordering._ROW, 33)).count().orderBy(F.desc("count")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert ranges[0]["count"] < 1500  # 3,000 rows share one key
    rows = sorted(got.collect(), key=lambda r: r["position"])
    assert [r["position"] for r in rows] == list(range(1, 4001))
    assert all(r["k"] is None for r in rows[:3000]) and [r["k"] for r in rows[3000:]] == list(range(0, 4000, 4))


def test_empty(spark):
    assert positioned(spark.range(0), [F.col("id").asc()], "n").collect() == []
