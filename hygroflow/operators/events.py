"""Windows around actuator events.

The readings around an event depend only on the minute in which it starts and
on whether it starts exactly on a (half) minute.  That pair is the *anchor*.
Many events share an anchor, a minute has at most four of them, so windows are
built per anchor: the exploded side is bounded by the calendar however many
events there are, and each event then picks its anchor's result by equality.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hygroflow.functions import clock, parsing
from hygroflow.operators import moments
from hygroflow.operators.quantiles import grouped_median
from hygroflow.operators.series import long_series, nearest_tick
from hygroflow.settings import BASELINE_IN, BASELINE_OUT, EventWindow

ANCHOR = ["half", "on_tick"]


def pump_rows(actuator_measure: DataFrame, floor: str, actuator: str = "1") -> DataFrame:
    """Rows of one actuator with a readable time; the floor compares text with text, on the stored clock."""
    return actuator_measure.where(
        (F.col("actuator_id") == actuator)
        & (F.col("start_time") >= F.lit(floor))
        & parsing.to_ts(F.col("start_time")).isNotNull()
    )


def distinct_events(
    actuator_measure: DataFrame, floor: str, identity: Sequence[str], actuator: str = "1"
) -> DataFrame:
    """Events without repeats of ``identity``, with ``ts`` and the anchor."""
    ts = parsing.to_ts(F.col("start_time"))
    second = clock.second_of_minute(ts)
    events = (
        pump_rows(actuator_measure, floor, actuator)
        .select(*identity)
        .distinct()
        .withColumn("ts", ts)
        .withColumn(
            "half",
            clock.minute_index(ts) * 2 + F.when(second >= 30, F.lit(1)).otherwise(F.lit(0)),
        )
        .withColumn("on_tick", second.isin(0, 30))
    )
    if "execution_time" in identity:
        events = events.withColumn("exec_secs", parsing.to_int(F.col("execution_time")))
    return events


def anchors(events: DataFrame) -> DataFrame:
    return events.select(*ANCHOR).distinct()


def anchor_offsets(points: DataFrame, window: EventWindow) -> DataFrame:
    """One row per anchor and minute of its two closed segments.

    ``off`` counts minutes from the minute in which the event starts; an event
    exactly on a minute has that minute in both segments.
    """
    exact = F.col("on_tick") & (F.col("half") % 2 == 0)
    return (
        points.withColumn("exact", exact)
        .withColumn(
            "off",
            F.explode(
                F.sequence(
                    F.when(F.col("exact"), F.lit(-window.before)).otherwise(
                        F.lit(1 - window.before)
                    ),
                    F.lit(window.after),
                )
            ),
        )
        .withColumn("minute", F.floor(F.col("half") / 2) + F.col("off"))
        .withColumn("in_pre", F.col("off") <= 0)
        .withColumn("in_post", (F.col("off") > 0) | (F.col("exact") & (F.col("off") == 0)))
    )


def grid_limits(wide: DataFrame) -> Column:
    """First and last minute of the two RH series: a scalar subquery of one struct."""
    picks = []
    for side in ("in", "out"):
        minute = f"CASE WHEN rh_{side} IS NOT NULL THEN minute END"
        picks += [f"min({minute}) AS first_{side}", f"max({minute}) AS last_{side}"]
    return wide.agg(F.expr(f"struct({', '.join(picks)}) AS limits")).scalar()


def segments(points: DataFrame, wide: DataFrame, window: EventWindow = EventWindow()) -> DataFrame:
    """Anchor minutes joined with the minute table; empty minutes stay as rows.

    ``grid_in``/``grid_out`` mark minutes between the first and last reading of
    the RH series: the dense RH series has a row there even without a value.
    """
    limits = grid_limits(wide)
    rows = anchor_offsets(points, window).join(wide, "minute", "left")
    for side in ("in", "out"):
        first, last = limits[f"first_{side}"], limits[f"last_{side}"]
        rows = rows.withColumn(
            f"grid_{side}", F.coalesce(F.col("minute").between(first, last), F.lit(False))
        )
    return rows


def _last(value: str, part: Column, present: Column) -> Column:
    return F.max_by(F.col(value), F.when(part & present, F.col("off")))


def window_stats(points: DataFrame, wide: DataFrame, window: EventWindow = EventWindow()) -> DataFrame:
    """Per anchor: row counts, means, slopes and net effects of RH and AH.

    AH series have no empty minutes, so the slope runs over the position among
    the present ones.  RH series are dense: an empty minute counts as a row and
    makes the slope missing.
    """
    in_order = (
        Window.partitionBy(*ANCHOR)
        .orderBy("off")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    rows = segments(points, wide, window)
    for side in ("in", "out"):
        rows = rows.withColumn(f"pos_{side}", F.count(f"ah_{side}").over(in_order))

    pre, post = F.col("in_pre"), F.col("in_post")
    ah_in, ah_out, rh_in, rh_out = (F.col(c).isNotNull() for c in ("ah_in", "ah_out", "rh_in", "rh_out"))
    stats = rows.groupBy(*ANCHOR).agg(
        F.count_if(pre & ah_in).alias("ah_n_pre"),
        F.count_if(post & ah_in).alias("ah_n_post"),
        F.count_if(ah_out).alias("ah_n_out"),
        F.avg(F.when(pre, F.col("ah_in"))).alias("ah_pre_mean"),
        F.regr_slope(F.when(pre, F.col("ah_in")), F.col("pos_in")).alias("ah_slope_in"),
        F.regr_slope(F.col("ah_out"), F.col("pos_out")).alias("ah_slope_out"),
        (_last("ah_in", post, ah_in) - _last("ah_in", pre, ah_in)).alias("ah_actual"),
        F.count_if(pre & F.col("grid_in")).alias("rh_n_pre"),
        F.count_if(post & F.col("grid_in")).alias("rh_n_post"),
        F.count_if(F.col("grid_out")).alias("rh_n_out"),
        F.count_if(pre & rh_in).alias("rh_valid_pre"),
        F.count_if(rh_out).alias("rh_valid_out"),
        F.avg(F.when(pre, F.col("rh_in"))).alias("rh_pre_mean"),
        F.regr_slope(F.when(pre, F.col("rh_in")), F.col("off")).alias("rh_slope_in"),
        F.regr_slope(F.col("rh_out"), F.col("off")).alias("rh_slope_out"),
        (
            _last("rh_in", post, F.col("grid_in")) - _last("rh_in", pre, F.col("grid_in"))
        ).alias("rh_actual"),
    )
    missing = F.lit(None).cast("double")
    stats = (
        stats.withColumn(
            "ah_slope_out", F.when(F.col("ah_n_out") > 1, F.col("ah_slope_out")).otherwise(0.0)
        )
        .withColumn(
            "rh_slope_in",
            F.when(F.col("rh_n_pre") == F.col("rh_valid_pre"), F.col("rh_slope_in")).otherwise(missing),
        )
        .withColumn(
            "rh_slope_out",
            F.when(F.col("rh_n_out") <= 1, F.lit(0.0))
            .when(F.col("rh_n_out") == F.col("rh_valid_out"), F.col("rh_slope_out"))
            .otherwise(missing),
        )
    )
    for signal in ("rh", "ah"):
        actual, inside, outside = (
            F.col(f"{signal}_{c}") for c in ("actual", "slope_in", "slope_out")
        )
        trend = BASELINE_IN * inside + BASELINE_OUT * outside
        stats = (
            stats.withColumn(f"{signal}_net_2a", actual - inside * window.after)
            .withColumn(f"{signal}_net_2b", actual - trend * window.after)
            .withColumn(
                f"{signal}_covered",
                (F.col(f"{signal}_n_pre") >= window.min_pre)
                & (F.col(f"{signal}_n_post") >= window.min_post),
            )
        )
    return stats


def nearest_minutes(points: DataFrame, wide: DataFrame) -> DataFrame:
    """(series, anchor, tick): the nearest minute of each humidity series to every anchor."""
    limits = grid_limits(wide)
    series = long_series(wide)
    at = points.select(
        F.explode(F.array(F.lit("ah_in"), F.lit("ah_out"))).alias("series"), *ANCHOR
    )
    ticks = series.where(F.col("series").startswith("ah")).select("series", "minute")
    ah_centres = nearest_tick(ticks, at)

    # a dense series has every minute, so its nearest one is arithmetic
    rounded = F.floor((F.col("half") + 1) / 2)
    rh_centres = None
    for side in ("in", "out"):
        first, last = limits[f"first_{side}"], limits[f"last_{side}"]
        part = points.select(
            F.lit(f"rh_{side}").alias("series"),
            *ANCHOR,
            F.least(F.greatest(rounded, first), last).alias("tick"),
        )
        rh_centres = part if rh_centres is None else rh_centres.unionByName(part)

    return ah_centres.select("series", *ANCHOR, "tick").unionByName(rh_centres)


def profile_traces(
    weighted: DataFrame, wide: DataFrame, window: EventWindow = EventWindow()
) -> DataFrame:
    """Zeroed traces per anchor, signal and side: (.., off, val, n).

    ``weighted``: anchors with ``n``, the number of events on each.  Every trace
    is centred on the nearest minute of its own series.  A pair of traces needs
    at most 30 % empty minutes and a baseline on both sides.
    """
    series = long_series(wide)
    minutes = (
        nearest_minutes(weighted, wide)
        .withColumn("off", F.explode(F.sequence(F.lit(-window.before), F.lit(window.after))))
        .withColumn("minute", F.col("tick") + F.col("off"))
        .join(series, ["series", "minute"], "left")
        .select(
            F.upper(F.split_part("series", F.lit("_"), F.lit(1))).alias("signal"),
            F.split_part("series", F.lit("_"), F.lit(2)).alias("side"),
            *ANCHOR,
            "off",
            "val",
        )
    )
    pair = Window.partitionBy("signal", *ANCHOR)
    inside, outside = F.col("side") == "in", F.col("side") == "out"
    empty = F.col("val").isNull()
    base = (F.col("off") < 0) & (F.col("off") >= -window.baseline_minutes)
    judged = minutes.select(
        "*",
        F.count_if(inside & empty).over(pair).alias("_gap_in"),
        F.count_if(outside & empty).over(pair).alias("_gap_out"),
        F.avg(F.when(inside & base, F.col("val"))).over(pair).alias("_base_in"),
        F.avg(F.when(outside & base, F.col("val"))).over(pair).alias("_base_out"),
    )
    limit = window.max_missing * window.points
    return (
        judged.where(
            (F.col("_gap_in") <= limit)
            & (F.col("_gap_out") <= limit)
            & F.col("_base_in").isNotNull()
            & F.col("_base_out").isNotNull()
        )
        .join(weighted.select(*ANCHOR, "n"), ANCHOR)
        .select(
            "signal",
            "side",
            *ANCHOR,
            "off",
            (F.col("val") - F.when(inside, F.col("_base_in")).otherwise(F.col("_base_out"))).alias(
                "val"
            ),
            "n",
        )
    )


def event_profile(traces: DataFrame) -> DataFrame:
    """Median, population deviation and event count per signal, side and minute offset.

    Rows of one multiplicity are summed up by themselves and the few states per
    signal, side and minute are merged; deviations never come from large sums.
    """
    keys = ["signal", "side", "off"]
    states = traces.groupBy(*keys, "n").agg(
        (F.count(F.lit(1)) * F.col("n")).alias("n_events"), moments.state(F.col("val")).alias("found")
    )
    spread = states.groupBy(*keys).agg(
        F.sum("n_events").alias("n_events"),
        moments.stddev_pop(moments.merged(moments.weighted(F.col("found"), F.col("n")))).alias("std"),
    )
    medians = grouped_median(traces, keys, "val", "median", weight="n")
    return spread.join(medians, keys, "left").select(*keys, "median", "std", "n_events")
