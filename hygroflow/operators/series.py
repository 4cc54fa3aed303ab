"""Minute series: medians, bounded gap fill, alignment and nearest ticks.

Everything after the minute median has at most 1,440 rows per series and day.
Order-dependent steps are partitioned by (series, day), never by series alone,
and neighbouring days exchange only their first and last reading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hygroflow.functions import clock, parsing
from hygroflow.functions.physics import absolute_humidity
from hygroflow.operators.quantiles import grouped_median
from hygroflow.settings import MINUTE_BANDS, SENSORS


def in_band(sensor: Column, value: Column, bands: dict) -> Column:
    """Plausibility test; every quantity has its own inclusive band."""
    test = None
    for quantity, (lo, hi) in bands.items():
        codes = [code for code, (_, q) in SENSORS.items() if q == quantity]
        inside = value.between(lo, hi)
        test = F.when(sensor.isin(codes), inside) if test is None else test.when(sensor.isin(codes), inside)
    return test.otherwise(F.lit(False))


def minute_readings(sensor_data: DataFrame, bands: dict = MINUTE_BANDS) -> DataFrame:
    """(sensor_id, minute, val) of plausible readings, 32-bit rounded."""
    return (
        sensor_data.where(F.col("sensor_id").isin(list(SENSORS)))
        .select(
            "sensor_id",
            clock.minute_index(parsing.to_ts(F.col("measure_date"))).alias("minute"),
            parsing.to_number32(F.col("data_value")).alias("val"),
        )
        .where(in_band(F.col("sensor_id"), F.col("val"), bands) & F.col("minute").isNotNull())
    )


def minute_median(readings: DataFrame) -> DataFrame:
    """One exact median per sensor and minute."""
    return grouped_median(readings, ["sensor_id", "minute"], "val", "val")


def day_chunk(minute: Column) -> Column:
    return F.floor(minute / clock.MINUTES_PER_DAY)


def with_next(series: DataFrame, key: str = "sensor_id") -> DataFrame:
    """Add ``next_minute`` and ``next_val``: the following reading of the same series.

    ``lead`` runs inside (series, day).  The last reading of a day takes the
    first reading of the next day that has any; those first readings form a
    table of one row per series and day, small enough to be ordered by series.
    """
    chunked = series.withColumn("_day", day_chunk(F.col("minute")))
    per_day = Window.partitionBy(key, "_day").orderBy("minute")
    per_series = Window.partitionBy(key).orderBy("_day")
    following = (
        chunked.groupBy(key, "_day")
        .agg(F.min("minute").alias("_m"), F.min_by("val", "minute").alias("_v"))
        .select(
            key,
            "_day",
            F.lead("_m").over(per_series).alias("_day_minute"),
            F.lead("_v").over(per_series).alias("_day_val"),
        )
    )
    return (
        chunked.withColumn("_in_minute", F.lead("minute").over(per_day))
        .withColumn("_in_val", F.lead("val").over(per_day))
        .join(following, [key, "_day"], "left")
        .select(
            *series.columns,
            F.coalesce("_in_minute", "_day_minute").alias("next_minute"),
            F.when(F.col("_in_minute").isNotNull(), F.col("_in_val"))
            .otherwise(F.col("_day_val"))
            .alias("next_val"),
        )
    )


def gap_fill(medians: DataFrame, limit: int = 5) -> DataFrame:
    """Fill the first ``limit`` missing minutes of every inner gap on the straight line."""
    gap = F.col("next_minute") - F.col("minute")
    # the last reading of a series has no next one and opens no gap
    steps = F.least(F.lit(limit).cast("long"), F.coalesce(gap, F.lit(1).cast("long")) - 1)
    return (
        with_next(medians)
        .withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), steps)))
        .select(
            "sensor_id",
            (F.col("minute") + F.col("_k")).alias("minute"),
            F.when(F.col("_k") == 0, F.col("val"))
            .otherwise(F.col("val") + (F.col("next_val") - F.col("val")) * F.col("_k") / gap)
            .alias("val"),
            (F.col("_k") > 0).alias("filled"),
        )
    )


def minute_wide(filled: DataFrame) -> DataFrame:
    """One row per minute with RH, temperature and absolute humidity of both sides.

    A conditional aggregate on the minute replaces the joins of four series:
    one shuffle, and absolute humidity exists where both inputs do.
    """
    picks = [
        F.max(F.when(F.col("sensor_id") == code, F.col("val"))).alias(f"{quantity}_{side}")
        for code, (side, quantity) in SENSORS.items()
    ]
    wide = filled.groupBy("minute").agg(*picks)
    for side in ("in", "out"):
        wide = wide.withColumn(
            f"ah_{side}", absolute_humidity(F.col(f"temp_{side}"), F.col(f"rh_{side}"))
        )
    return wide


def minute_series(sensor_data: DataFrame, limit: int = 5) -> DataFrame:
    """Text readings to the aligned, gap-filled minute table."""
    return minute_wide(gap_fill(minute_median(minute_readings(sensor_data)), limit))


def long_series(wide: DataFrame) -> DataFrame:
    """(series, minute, val) for the four humidity series of the event study."""
    names = ("rh_in", "rh_out", "ah_in", "ah_out")
    pairs = [F.struct(F.lit(n).alias("series"), F.col(n).alias("val")) for n in names]
    return (
        wide.select("minute", F.explode(F.array(*pairs)).alias("p"))
        .select("p.series", "minute", "p.val")
        .where(F.col("val").isNotNull())
    )


def nearest_tick(ticks: DataFrame, points: DataFrame) -> DataFrame:
    """For every (series, half) point the nearest minute of that series, a tie going later.

    ``ticks``: (series, minute).  ``points``: (series, half, on_tick) where
    ``half`` counts half minutes since the epoch and ``on_tick`` says that the
    point lies exactly on it.  The nearer of the two neighbours changes only at
    half minutes, hence this key decides the answer; there are at most four
    points per minute, so a (series, day) partition is bounded.
    Adds ``tick``.
    """
    tick_rows = ticks.select(
        "series",
        (F.col("minute") * 2).alias("half"),
        F.lit(None).cast("boolean").alias("on_tick"),
        F.col("minute").alias("_tick"),
    )
    point_rows = points.select(
        "series", "half", "on_tick", F.lit(None).cast("long").alias("_tick")
    ).distinct()
    day = F.floor(F.col("half") / (2 * clock.MINUTES_PER_DAY))
    rows = tick_rows.unionByName(point_rows).withColumn("_day", day)

    before = Window.partitionBy("series").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("series").orderBy("_day").rowsBetween(1, Window.unboundedFollowing)
    carried = (
        rows.groupBy("series", "_day")
        .agg(F.min("_tick").alias("_first"), F.max("_tick").alias("_last"))
        .select(
            "series",
            "_day",
            F.last("_last", ignorenulls=True).over(before).alias("_earlier"),
            F.first("_first", ignorenulls=True).over(after).alias("_later"),
        )
    )

    # a tick sorts before the points of its own half minute
    order = [F.col("half"), F.col("on_tick").asc_nulls_first()]
    per_day = Window.partitionBy("series", "_day")
    back = per_day.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ahead = per_day.orderBy(*[F.col("half").desc(), F.col("on_tick").desc_nulls_last()]).rowsBetween(
        Window.unboundedPreceding, 0
    )
    found = (
        rows.withColumn("_prev", F.max("_tick").over(back))
        .withColumn("_next", F.min("_tick").over(ahead))
        .where(F.col("on_tick").isNotNull())
        .join(carried, ["series", "_day"])
        .withColumn("_prev", F.coalesce("_prev", "_earlier"))
        .withColumn("_next", F.coalesce("_next", "_later"))
    )
    # past the midpoint, or on it: the later minute
    middle = F.col("_prev") + F.col("_next")
    later = F.col("half") >= middle
    return found.select(
        "series",
        "half",
        "on_tick",
        F.when(F.col("_prev").isNull(), F.col("_next"))
        .when(F.col("_next").isNull(), F.col("_prev"))
        .when(F.col("on_tick") & (F.col("half") == 2 * F.col("_prev")), F.col("_prev"))
        .when(later, F.col("_next"))
        .otherwise(F.col("_prev"))
        .alias("tick"),
    )
