"""Slope classifier: trends before and after an event and a five-class label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hygroflow.functions import scoring
from hygroflow.settings import EventWindow, SlopeRule


def _number() -> Column:
    """Event number: a digest of the natural key, in which a missing part differs from any text."""
    parts = [
        F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-"))
        for c in ("start_time", "execution_time", "state")
    ]
    return F.conv(F.substring(F.sha2(F.concat(*parts), 256), 1, 15), 16, 10).cast("long").alias("id_evento")


def _start() -> Column:
    return F.floor(F.col("half") / 2).alias("start_minute")


def minute_metrics(starts: DataFrame, wide: DataFrame, window: EventWindow = EventWindow()) -> DataFrame:
    """Relative minutes with inside and outside RH per start minute, however many events share it."""
    offsets = F.sequence(F.lit(-window.before), F.lit(window.after))
    return (
        starts.select("start_minute")
        .distinct()
        .select("start_minute", F.explode(offsets).alias("off"))
        .withColumn("minute", F.col("start_minute") + F.col("off"))
        .join(wide.select("minute", "rh_in", "rh_out"), "minute")
        .where(F.col("rh_in").isNotNull() | F.col("rh_out").isNotNull())
        .select(
            "start_minute",
            F.col("off").cast("double").alias("tiempo_relativo"),
            F.col("rh_in").alias("humedad"),
            F.col("rh_out").alias("humedad_externa"),
        )
    )


def _numbered(events: DataFrame) -> DataFrame:
    slot = scoring.slot_label(scoring.slot_number(F.hour("ts"))).alias("franja")
    return events.select(_number(), _start(), slot)


def event_relative_metrics(
    events: DataFrame, wide: DataFrame, window: EventWindow = EventWindow()
) -> DataFrame:
    """Events by relative minute with inside and outside RH.

    The published analysis reads this from a view whose definition is not
    public; here it is inferred: whole minutes from the minute of the start,
    rows where either side has a value, the time slot of the start.  The event
    number is a digest of the natural key, so re-runs give the same one; rows
    belong together by the natural key, never by the number alone.
    """
    numbered = _numbered(events)
    return numbered.join(minute_metrics(numbered, wide, window), "start_minute").select(
        "id_evento", "tiempo_relativo", "humedad", "humedad_externa", "franja"
    )


def _trend(value: str, part: Column) -> Column:
    """OLS slope on the relative minute; missing when any value of the segment is."""
    whole = F.count_if(part) == F.count_if(part & F.col(value).isNotNull())
    slope = F.regr_slope(F.when(part, F.col(value)), F.col("tiempo_relativo"))
    return F.when(whole & (F.count_if(part) >= 3), slope)


def slope_features(
    events: DataFrame, wide: DataFrame, rule: SlopeRule = SlopeRule(), window: EventWindow = EventWindow()
) -> DataFrame:
    """Slopes inside, outside and relative, before and after, of events with enough rows.

    They depend on the start minute alone: computed once for each, and every
    event picks its own up by equality.
    """
    pre, post = F.col("tiempo_relativo") < 0, F.col("tiempo_relativo") >= 0
    numbered = _numbered(events)
    features = (
        minute_metrics(numbered, wide, window)
        .groupBy("start_minute")
        .agg(
            F.count_if(pre).alias("n_pre"),
            F.count_if(post).alias("n_post"),
            _trend("humedad", pre).alias("slope_internal_pre"),
            _trend("humedad_externa", pre).alias("slope_external_pre"),
            _trend("humedad", post).alias("slope_internal_post"),
            _trend("humedad_externa", post).alias("slope_external_post"),
        )
        .where((F.col("n_pre") >= rule.min_pre) & (F.col("n_post") >= rule.min_post))
        .withColumn(
            "slope_relative_pre", F.col("slope_internal_pre") - F.col("slope_external_pre")
        )
        .withColumn(
            "slope_relative_post", F.col("slope_internal_post") - F.col("slope_external_post")
        )
        .withColumn("delta_detach", F.col("slope_relative_post") - F.col("slope_relative_pre"))
    )
    return numbered.join(features, "start_minute").drop("start_minute")


def slope_class(features: DataFrame, rule: SlopeRule = SlopeRule()) -> DataFrame:
    return features.withColumn(
        "class_v0",
        scoring.slope_class(F.col("delta_detach"), F.col("slope_relative_post"), rule),
    )
