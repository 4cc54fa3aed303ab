"""Exploration of unified measures: long table, slices and pivots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hygroflow.functions import clock, parsing

# names of the measures; only the two temperatures and w_temp are published, the rest follow them
SENSOR_MEASURES = {
    "101": "Humidity 1",
    "102": "Temperature 1",
    "103": "Humidity 2",
    "104": "Temperature 2",
}
WEATHER_MEASURES = {
    "temperature_2m": "w_temp",
    "relative_humidity_2m": "w_humidity",
    "rain": "w_rain",
    "surface_pressure": "w_pressure",
    "wind_speed_10m": "w_wind",
}
COMPARED = ("Temperature 1", "Temperature 2", "w_temp")


def unified_measures(sensor_data: DataFrame, weather_hourly: DataFrame) -> DataFrame:
    """Hourly minimum, mean and maximum per measure, sensors and weather in one long table.

    Inferred: the published analysis reads a view without public definition.
    """
    names = F.create_map(*[F.lit(x) for pair in SENSOR_MEASURES.items() for x in pair])
    hour = clock.bucket(F.col("ts"), "1 hour")
    sensors = (
        sensor_data.where(F.col("sensor_id").isin(list(SENSOR_MEASURES)))
        .select(
            "sensor_id",
            parsing.to_ts(F.col("measure_date")).alias("ts"),
            parsing.nan_to_null(parsing.to_number(F.col("data_value"))).alias("val"),
        )
        .where(F.col("val").isNotNull())
        .groupBy(hour.alias("fecha_hora"), "sensor_id")
        .agg(
            F.min("val").alias("value_min"),
            F.avg("val").alias("value_avg"),
            F.max("val").alias("value_max"),
        )
        .select("fecha_hora", names[F.col("sensor_id")].alias("medida"), "value_min", "value_avg", "value_max")
    )
    weather = (
        weather_hourly.withColumnsRenamed(WEATHER_MEASURES)
        .unpivot("datetime", list(WEATHER_MEASURES.values()), "medida", "v")
        .where(F.col("v").isNotNull())
        .select(
            F.col("datetime").alias("fecha_hora"),
            "medida",
            F.col("v").alias("value_min"),
            F.col("v").alias("value_avg"),
            F.col("v").alias("value_max"),
        )
    )
    return sensors.unionByName(weather)


def time_slice(measures: DataFrame, start: str, end: str | None = None) -> DataFrame:
    """Half-open slice [start, end)."""
    kept = measures.where(F.col("fecha_hora") >= F.lit(start).cast("timestamp_ntz"))
    return kept if end is None else kept.where(F.col("fecha_hora") < F.lit(end).cast("timestamp_ntz"))


def measure_series(measures: DataFrame, name: str, start: str) -> DataFrame:
    """One measure from ``start`` on; ordering belongs to the sink."""
    return time_slice(measures.where(F.col("medida") == name), start)


def measures_pivot(sliced: DataFrame, names: Sequence[str] = COMPARED) -> DataFrame:
    """Mean value per time and measure; the listed names spare the discovery job."""
    return (
        sliced.where(F.col("medida").isin(list(names)))
        .groupBy("fecha_hora")
        .pivot("medida", list(names))
        .agg(F.avg("value_avg"))
    )


def head(pivoted: DataFrame, rows: int = 48) -> DataFrame:
    """First rows in time order; a top-k, not a global sort."""
    return pivoted.orderBy("fecha_hora").limit(rows)
