"""Ten-minute averages on the local clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hygroflow.functions import clock, parsing
from hygroflow.functions.physics import absolute_humidity
from hygroflow.operators.series import in_band
from hygroflow.settings import BUCKET_BANDS, SENSORS, Clock

COMPLETE = ["temp_in", "temp_out", "ah_in", "ah_out"]


def plausible_readings(
    sensor_data: DataFrame, period: Clock, bands: dict = BUCKET_BANDS
) -> DataFrame:
    """(sensor_id, ts, local_ts, val) of the period; sensor filter first, it reaches the scan."""
    return (
        sensor_data.where(F.col("sensor_id").isin(list(SENSORS)))
        .select(
            "sensor_id",
            parsing.to_ts(F.col("measure_date")).alias("ts"),
            parsing.to_number(F.col("data_value")).alias("val"),
        )
        .where(F.col("ts") >= F.lit(period.floor).cast("timestamp_ntz"))
        .where(in_band(F.col("sensor_id"), F.col("val"), bands))
        .withColumn("local_ts", clock.shifted(F.col("ts"), period.shift_hours))
    )


def bucket_averages(readings: DataFrame, width: str = "10 minutes") -> DataFrame:
    """(local_bucket, sensor_id, avg_val)."""
    return readings.groupBy(
        clock.bucket(F.col("local_ts"), width).alias("local_bucket"), "sensor_id"
    ).agg(F.avg("val").alias("avg_val"))


def _mean_of(code: str) -> Column:
    return F.avg(F.when(F.col("sensor_id") == code, F.col("val")))


def bucket_table(readings: DataFrame, width: str = "10 minutes") -> DataFrame:
    """One row per bucket with the four averages, absolute humidity and the deltas.

    The averages are conditional aggregates of one grouping, so bucket average
    and pivot cost a single shuffle of partial sums.
    """
    means = [
        _mean_of(code).alias(f"{quantity}_{side}") for code, (side, quantity) in SENSORS.items()
    ]
    wide = readings.groupBy(clock.bucket(F.col("local_ts"), width).alias("local_bucket")).agg(*means)
    return (
        wide.withColumn("hour", F.hour("local_bucket"))
        .withColumn("day", clock.day_text(F.col("local_bucket")))
        .withColumn("ah_in", absolute_humidity(F.col("temp_in"), F.col("rh_in")))
        .withColumn("ah_out", absolute_humidity(F.col("temp_out"), F.col("rh_out")))
        .withColumn("temp_delta", F.col("temp_in") - F.col("temp_out"))
        .withColumn("ah_delta", F.col("ah_in") - F.col("ah_out"))
    )


def complete(buckets: DataFrame) -> DataFrame:
    """Buckets with both temperatures and both absolute humidities."""
    return buckets.dropna(subset=COMPLETE)
