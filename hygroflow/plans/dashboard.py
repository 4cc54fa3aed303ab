"""Environment dashboard: buckets, profiles, key figures and daily event effect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hygroflow.functions import clock, parsing, scoring
from hygroflow.functions.rounding import round_exact, round_scaled
from hygroflow.operators import buckets as bk
from hygroflow.operators import events as ev
from hygroflow.operators.quantiles import grouped_median
from hygroflow.settings import AH_EDGES, DASHBOARD_CLOCK, Clock, EventWindow

MEANS = ["temp_in", "temp_out", "temp_delta", "ah_in", "ah_out", "ah_delta"]
DAYTIME = (6, 19)
NIGHT = (0, 5)
SATURATED = 99


def bucket_table(sensor_data: DataFrame, period: Clock = DASHBOARD_CLOCK) -> DataFrame:
    return bk.bucket_table(bk.plausible_readings(sensor_data, period))


# -- profiles ---------------------------------------------------------------
def hourly_profile(buckets: DataFrame) -> DataFrame:
    """Mean of the complete buckets by hour of day; hours without data are zero."""
    by_hour = (
        bk.complete(buckets)
        .groupBy("hour")
        .agg(*[F.avg(c).alias(c) for c in MEANS], F.count("temp_in").alias("n"))
    )
    spine = buckets.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    return spine.join(by_hour, "hour", "left").na.fill(0.0, MEANS).na.fill(0, ["n"])


def daily_env(buckets: DataFrame) -> DataFrame:
    return bk.complete(buckets).groupBy("day").agg(*[F.avg(c).alias(f"avg_{c}") for c in MEANS])


def completeness(buckets: DataFrame) -> DataFrame:
    whole = F.lit(True)
    for c in bk.COMPLETE:
        whole = whole & F.col(c).isNotNull()
    return buckets.agg(
        F.count(F.lit(1)).alias("total_buckets"),
        F.count_if(whole).alias("complete_buckets"),
        F.min("day").alias("first_day"),
        F.max("day").alias("last_day"),
    )


# -- pump -------------------------------------------------------------------
def pump_daily(actuator_measure: DataFrame, period: Clock = DASHBOARD_CLOCK) -> DataFrame:
    """Attempts and successes per local day; repeated rows count."""
    ts = parsing.to_ts(F.col("start_time"))
    return (
        ev.pump_rows(actuator_measure, period.floor)
        .groupBy(clock.day_text(clock.shifted(ts, period.shift_hours)).alias("local_day"))
        .agg(
            F.count(F.lit(1)).alias("n_events"),
            F.count_if(F.col("state") == "1").alias("n_success"),
        )
    )


def event_effects(
    wide: DataFrame,
    actuator_measure: DataFrame,
    period: Clock = DASHBOARD_CLOCK,
    window: EventWindow = EventWindow(),
    stats: DataFrame | None = None,
) -> DataFrame:
    """Net absolute-humidity effect of every sufficiently covered event.

    ``wide`` is the minute table; it is read more than once, so store it first.
    ``stats``: window statistics that hold all anchors of the events, if they are known.
    """
    events = ev.distinct_events(actuator_measure, period.floor, ["start_time", "state"])
    stats = ev.window_stats(ev.anchors(events), wide, window) if stats is None else stats
    stats = stats.where("ah_covered").select(*ev.ANCHOR, F.col("ah_net_2b").alias("ah_net"))
    return events.join(stats, ev.ANCHOR).select(
        "ts",
        "state",
        clock.day_text(clock.shifted(F.col("ts"), period.shift_hours)).alias("local_day"),
        "ah_net",
        scoring.score(F.col("ah_net"), AH_EDGES).alias("ah_score"),
    )


def event_daily(effects: DataFrame) -> DataFrame:
    """Per local day: events, median net effect, median score, share of positive events.

    Scores take eight values, so their counts per day are tiny and the median
    is a weighted one; the median of the net effect takes the splitting path.
    """
    scores = (
        effects.groupBy("local_day", "ah_score")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count("ah_net").alias("n"),
            F.count_if(F.col("ah_net") > 0).alias("positive"),
        )
        .groupBy("local_day")
        .agg(
            F.sum("n").alias("n_events"),
            F.expr("percentile(ah_score, 0.5, rows)").alias("median_score"),
            (F.sum("positive") / F.sum("rows") * 100).alias("pct_positive"),
        )
    )
    nets = grouped_median(effects, ["local_day"], "ah_net", "median_net")
    return scores.join(nets, "local_day", "left").select(
        "local_day", "n_events", "median_net", "median_score", "pct_positive"
    )


def daily_full(buckets: DataFrame, pump: DataFrame, daily_events: DataFrame) -> DataFrame:
    """Every day with sensor data, with its environment, attempts and event effect."""
    env = [f"avg_{c}" for c in MEANS]
    # the day spine and the daily means are one aggregate: avg skips what is not complete
    whole = F.lit(True)
    for c in bk.COMPLETE:
        whole = whole & F.col(c).isNotNull()
    days = buckets.groupBy("day").agg(*[F.avg(F.when(whole, F.col(c))).alias(f"avg_{c}") for c in MEANS])
    return (
        days.join(pump.withColumnRenamed("local_day", "day"), "day", "left")
        .join(
            daily_events.select(
                F.col("local_day").alias("day"),
                F.col("n_events").alias("ev_n_events"),
                "median_net",
                "median_score",
                "pct_positive",
            ),
            "day",
            "left",
        )
        .na.fill(0, ["n_events", "n_success"])
        .select(
            "day",
            "n_events",
            "n_success",
            *env,
            "ev_n_events",
            "median_net",
            "median_score",
            "pct_positive",
            (F.col("n_events") > 0).alias("pump_active"),
        )
    )


# -- key figures ------------------------------------------------------------
def _is_between(hours: tuple[int, int]) -> Column:
    return F.col("hour").between(*hours)


def kpi_daytime(buckets: DataFrame) -> DataFrame:
    return (
        bk.complete(buckets)
        .where(_is_between(DAYTIME))
        .agg(
            round_scaled(F.avg("temp_delta"), 2).alias("avg_temp_lift"),
            round_scaled(F.max("temp_delta"), 2).alias("peak_temp_lift"),
            round_scaled(F.avg("ah_delta"), 3).alias("avg_ah_enrich"),
            round_scaled(F.max("ah_delta"), 3).alias("peak_ah_enrich"),
            round_scaled(F.avg("temp_in"), 1).alias("avg_daytime_temp_in"),
            round_scaled(F.avg("temp_out"), 1).alias("avg_daytime_temp_out"),
            round_scaled(F.avg("ah_in"), 2).alias("avg_daytime_ah_in"),
            round_scaled(F.avg("ah_out"), 2).alias("avg_daytime_ah_out"),
        )
    )


def kpi_peak_hours(buckets: DataFrame) -> DataFrame:
    """Hour of the largest daytime temperature lift and hour with the largest mean AH surplus.

    Both take the first row on a tie: the earliest bucket, the earliest hour.
    """
    full = bk.complete(buckets)
    earliest = -clock.minute_index(F.col("local_bucket"))
    lift = full.agg(
        F.max_by(
            "hour",
            F.when(_is_between(DAYTIME), F.struct(F.col("temp_delta"), earliest)),
        ).alias("peak_temp_hour")
    )
    surplus = (
        full.groupBy("hour")
        .agg(F.avg("ah_delta").alias("d"))
        .agg(F.max_by("hour", F.struct(F.col("d"), -F.col("hour"))).alias("peak_ah_hour"))
    )
    # two single rows become one
    nothing = F.lit(None).cast("int")
    return (
        lift.select("peak_temp_hour", nothing.alias("peak_ah_hour"))
        .unionByName(surplus.select(nothing.alias("peak_temp_hour"), "peak_ah_hour"))
        .agg(F.max("peak_temp_hour").alias("peak_temp_hour"), F.max("peak_ah_hour").alias("peak_ah_hour"))
    )


def ah_correlation(buckets: DataFrame) -> DataFrame:
    return bk.complete(buckets).agg(F.corr("ah_in", "ah_out").alias("ah_corr"))


def kpi_shares(buckets: DataFrame) -> DataFrame:
    """Nights cooler inside (complete buckets) and RH at the sensor's limit (all buckets)."""
    whole = _is_between(NIGHT)
    for c in bk.COMPLETE:
        whole = whole & F.col(c).isNotNull()
    return buckets.agg(
        (F.count_if(whole & (F.col("temp_delta") < 0)) / F.nullif(F.count_if(whole), F.lit(0)) * 100)
        .alias("night_cool_pct"),
        (F.count_if(F.col("rh_in") >= SATURATED) / F.nullif(F.count("rh_in"), F.lit(0)) * 100)
        .alias("rh_sat_pct"),
    )


def kpi_pump(daily_events: DataFrame) -> DataFrame:
    """Medians and means over days, and both counts of positive days.

    The input has one row per calendar day, so the global median is bounded.
    """
    return daily_events.agg(
        round_scaled(F.median("median_score"), 2).alias("overall_median_score"),
        round_scaled(F.avg("pct_positive"), 1).alias("overall_pct_positive"),
        F.count(F.lit(1)).alias("n_pump_days"),
        F.count_if(F.col("pct_positive") >= 50).alias("days_mostly_positive"),
        F.count_if((F.col("n_events") > 0) & (F.col("median_score") >= 1)).alias(
            "days_score_positive"
        ),
    )


def days_without_pump(buckets: DataFrame, pump: DataFrame) -> DataFrame:
    """Sensor days, and those of them without a pump attempt (set difference)."""
    active = pump.select(F.col("local_day").alias("day"), F.lit(True).alias("active"))
    return (
        buckets.select("day")
        .distinct()
        .join(active, "day", "left")
        .agg(
            F.count(F.lit(1)).alias("n_sensor_days"),
            F.count_if(F.col("active").isNull()).alias("n_no_pump_days"),
        )
    )


# -- chart data -------------------------------------------------------------
def chart_hourly(profile: DataFrame) -> DataFrame:
    digits = {"temp_in": 2, "temp_out": 2, "ah_in": 3, "ah_out": 3, "temp_delta": 3, "ah_delta": 3}
    return profile.select(
        clock.hour_label(F.col("hour")).alias("label"),
        *[round_exact(F.col(c), d).alias(c) for c, d in digits.items()],
    )


def chart_daily(full: DataFrame) -> DataFrame:
    rounded = [f"avg_{c}" for c in MEANS] + ["median_score", "pct_positive"]
    return full.select(
        "day",
        *[round_exact(parsing.nan_to_null(F.col(c)), 3).alias(c) for c in rounded],
        "n_events",
        "pump_active",
    )
