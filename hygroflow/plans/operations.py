"""Operations deck: connectivity of sensors and success of pump attempts.

Days are local days.  Counting hours and windows uses one small state per
group (a bit mask, two booleans), so partial aggregates absorb any hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hygroflow.functions import clock, parsing, scoring
from hygroflow.operators.events import pump_rows
from hygroflow.settings import OPERATIONS_CLOCK, SENSORS, STATES, Clock


def _percent(part, whole):
    """Half-even percentage to one decimal, missing without a base."""
    return F.bround(F.try_divide(part, whole) * 100, 1)


def online_hours(sensor_data: DataFrame, period: Clock = OPERATIONS_CLOCK) -> DataFrame:
    """Distinct hours with at least one reading, per sensor and day."""
    local = clock.shifted(parsing.to_ts(F.col("measure_date")), period.shift_hours)
    return (
        sensor_data.where(F.col("sensor_id").isin(list(SENSORS)))
        .select("sensor_id", local.alias("local"))
        .where(F.col("local").isNotNull())
        .groupBy("sensor_id", clock.day_text(F.col("local")).alias("day"))
        .agg(
            F.bit_count(F.bit_or(F.call_function("shiftleft", F.lit(1), F.hour("local")))).alias(
                "online_hours"
            )
        )
        .withColumn("pct_online", _percent(F.col("online_hours"), F.lit(24)))
    )


def online_totals(hours: DataFrame) -> DataFrame:
    return hours.groupBy("sensor_id").agg(
        F.sum("online_hours").alias("total_hours"),
        F.bround(F.sum("online_hours") / (F.count(F.lit(1)) * 24) * 100, 1).alias("avg_pct_online"),
        F.count(F.lit(1)).alias("days_with_data"),
    )


def attempts(actuator_measure: DataFrame, period: Clock = OPERATIONS_CLOCK) -> DataFrame:
    """(local_ts, day, state) of every attempt of the period."""
    local = clock.shifted(parsing.to_ts(F.col("start_time")), period.shift_hours)
    return (
        pump_rows(actuator_measure, period.floor)
        .select(local.alias("local_ts"), "state")
        .withColumn("day", clock.day_text(F.col("local_ts")))
    )


def attempts_by_state(rows: DataFrame) -> DataFrame:
    """Attempts per day and state on an unbroken calendar; days without attempts are zero."""
    names = [*(f"s{s}" for s in STATES), "total"]
    counts = rows.groupBy("day").agg(
        *[F.count_if(F.col("state") == s).alias(f"s{s}") for s in STATES],
        F.count(F.lit(1)).alias("total"),
    )
    day = F.col("day").cast("date")
    ends = counts.agg(F.min(day).alias("first"), F.max(day).alias("last")).where(F.col("first").isNotNull())
    spine = ends.select(F.explode(F.sequence("first", "last")).alias("day")).select(F.col("day").cast("string"))
    return spine.join(counts, "day", "left").select("day", *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names])


def raw_success(daily: DataFrame) -> DataFrame:
    """Share of state 1 among all attempts, per day and in total, out of one aggregate."""
    return (
        daily.groupingSets([["day"], []], "day")
        .agg(
            F.sum("total").alias("attempts"),
            F.sum("s1").alias("successes"),
            F.grouping("day").alias("over_all"),
        )
        .select(
            F.when(F.col("over_all") == 1, F.lit("total")).otherwise(F.col("day")).alias("day"),
            "attempts",
            "successes",
            _percent(F.col("successes"), F.nullif(F.col("attempts"), F.lit(0))).alias("rate_pct"),
        )
    )


def net_windows(rows: DataFrame, width: str = "10 minutes") -> DataFrame:
    """Windows in which a pump run was wanted (state 1 or 2) and whether one succeeded."""
    return (
        rows.groupBy(clock.bucket(F.col("local_ts"), width).alias("window_start"))
        .agg(
            F.bool_or(F.col("state").isin("1", "2")).alias("needed"),
            F.bool_or(F.col("state") == "1").alias("solved"),
        )
        .where("needed")
        .select("window_start", "solved")
    )


def net_success(rows: DataFrame) -> DataFrame:
    """Needed, solved and failed windows per day and in total."""
    per_day = (
        net_windows(rows)
        .groupBy(clock.day_text(F.col("window_start")).alias("day"))
        .agg(F.count(F.lit(1)).alias("need"), F.count_if(F.col("solved")).alias("succ"))
    )
    total = per_day.agg(
        F.lit("total").alias("day"),
        F.coalesce(F.sum("need"), F.lit(0)).alias("need"),
        F.coalesce(F.sum("succ"), F.lit(0)).alias("succ"),
    )
    return (
        per_day.unionByName(total)
        .withColumn("failed", F.col("need") - F.col("succ"))
        .withColumn("rate_pct", _percent(F.col("succ"), F.nullif(F.col("need"), F.lit(0))))
    )


def daily_grades(sensor_data: DataFrame, actuator_measure: DataFrame, period: Clock = OPERATIONS_CLOCK) -> DataFrame:
    """Daily table of hours, attempts and graded rates, for days with any data.

    As in the published table a day counts when it has attempts or hours of the
    first sensor; a sensor without hours has no percentage online.
    """
    hours = online_hours(sensor_data, period)
    wide_hours = hours.groupBy("day").agg(
        *[
            F.max(F.when(F.col("sensor_id") == s, F.col(c))).alias(f"{name}_{s}")
            for s in SENSORS
            for name, c in (("hours", "online_hours"), ("online_pct", "pct_online"))
        ]
    )
    per_window = (
        attempts(actuator_measure, period)
        .groupBy("day", clock.bucket(F.col("local_ts")).alias("window_start"))
        .agg(
            *[F.count_if(F.col("state") == s).alias(f"s{s}") for s in STATES],
            F.count(F.lit(1)).alias("total"),
        )
    )
    needed = (F.col("s1") > 0) | (F.col("s2") > 0)
    counts = per_window.groupBy("day").agg(
        *[F.sum(c).alias(c) for c in [*(f"s{s}" for s in STATES), "total"]],
        F.count_if(needed).alias("need"),
        F.count_if(F.col("s1") > 0).alias("succ"),
    )
    first = f"hours_{next(iter(SENSORS))}"
    return (
        wide_hours.join(counts, "day", "full")
        .na.fill(0, [*(f"hours_{s}" for s in SENSORS), *counts.drop("day").columns])
        .where((F.col("total") > 0) | (F.col(first) > 0))
        .withColumn("raw_pct", _percent(F.col("s1"), F.nullif(F.col("total"), F.lit(0))))
        .withColumn("net_pct", _percent(F.col("succ"), F.nullif(F.col("need"), F.lit(0))))
        .select(
            "day",
            *[f"hours_{s}" for s in SENSORS],
            *[f"online_pct_{s}" for s in SENSORS],
            "s1",
            "s0",
            "raw_pct",
            "net_pct",
            scoring.grade(F.col("raw_pct")).alias("raw_grade"),
            scoring.grade(F.col("net_pct")).alias("net_grade"),
        )
    )
