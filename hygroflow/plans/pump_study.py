"""Pump influence study: per-event effect on RH and AH, scores, profiles and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hygroflow.functions import clock, scoring, student
from hygroflow.operators import events as ev
from hygroflow.operators import moments
from hygroflow.operators import series as sr
from hygroflow.session import stored
from hygroflow.settings import AH_EDGES, RH_EDGES, SLOTS, STUDY_CLOCK, Clock, EventWindow

EDGES = {"RH": RH_EDGES, "AH": AH_EDGES}
IDENTITY = ["start_time", "execution_time", "state"]


def study_events(actuator_measure: DataFrame, period: Clock = STUDY_CLOCK) -> DataFrame:
    return ev.distinct_events(actuator_measure, period.floor, IDENTITY)


def event_net(
    events: DataFrame,
    wide: DataFrame,
    period: Clock = STUDY_CLOCK,
    window: EventWindow = EventWindow(),
    stats: DataFrame | None = None,
) -> DataFrame:
    """One row per event with enough data on both signals.

    ``stats``: window statistics that hold all anchors of the events, if they are known.
    """
    stats = ev.window_stats(ev.anchors(events), wide, window) if stats is None else stats
    stats = stats.where("rh_covered and ah_covered")
    measured = ["pre_mean", "actual", "net_2a", "net_2b"]
    hour = F.hour(clock.shifted(F.col("ts"), period.shift_hours))
    return events.join(
        stats.select(*ev.ANCHOR, *[f"{s}_{m}" for s in ("rh", "ah") for m in measured]), ev.ANCHOR
    ).select(
        "ts",
        "state",
        "exec_secs",
        *ev.ANCHOR,
        scoring.slot_number(hour).alias("slot_no"),
        *[f"{s}_{m}" for s in ("rh", "ah") for m in measured],
        scoring.score(F.col("rh_net_2b"), RH_EDGES).alias("rh_score"),
        scoring.score(F.col("ah_net_2b"), AH_EDGES).alias("ah_score"),
    )


def traces(net: DataFrame, wide: DataFrame, window: EventWindow = EventWindow()) -> DataFrame:
    """Zeroed traces of the covered events' anchors."""
    # a few rows per minute, read by every series
    weighted = stored(net.groupBy(*ev.ANCHOR).agg(F.count(F.lit(1)).alias("n")), "weighted_anchors")
    return ev.profile_traces(weighted, wide, window)


def event_profile(net: DataFrame, wide: DataFrame, window: EventWindow = EventWindow()) -> DataFrame:
    """Normalised event response of the covered events, RH and AH, inside and outside."""
    return ev.event_profile(traces(net, wide, window))


def _spine(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few fixed rows as a relation without a Python source: inline array of structs."""
    names = [part.split()[0] for part in schema.split(",")]
    structs = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


BASELINES = ("2a", "2b")


def study_state(net: DataFrame) -> DataFrame:
    """One state per slot, signal and score: events, and moments of the net effects.

    At most 64 rows, built in one aggregate with partial sums.  Histogram, slot
    summary, box plot and t-test are all unions of these states.
    """
    pairs = [
        F.struct(
            F.lit(signal).alias("signal"),
            F.col(f"{signal.lower()}_score").alias("score"),
            *[F.col(f"{signal.lower()}_net_{b}").alias(f"net_{b}") for b in BASELINES],
        )
        for signal in EDGES
    ]
    return (
        net.select("slot_no", F.inline(F.array(*pairs)))
        .groupBy("slot_no", "signal", "score")
        .agg(F.count(F.lit(1)).alias("n_events"), *[moments.state(F.col(f"net_{b}")).alias(f"net_{b}") for b in BASELINES])
    )


def score_histogram(state: DataFrame) -> DataFrame:
    """Events per score on the full 0..7 axis, per signal."""
    spine = _spine(
        state.sparkSession, [(s, i) for s in EDGES for i in range(len(RH_EDGES) + 1)], "signal string, score int"
    )
    counts = state.groupBy("signal", "score").agg(F.sum("n_events").alias("n_events"))
    label = F.when(F.col("signal") == "RH", scoring.score_label(F.col("score"), RH_EDGES, 1)).otherwise(
        scoring.score_label(F.col("score"), AH_EDGES, 2)
    )
    return (
        spine.join(counts, ["signal", "score"], "left")
        .na.fill(0, ["n_events"])
        .withColumn("label", label)
    )


def slot_spine(spark: SparkSession) -> DataFrame:
    return _spine(spark, [(n, label) for n, _, _, label in SLOTS], "slot_no int, slot string")


def slot_summary(state: DataFrame) -> DataFrame:
    is_ah = F.col("signal") == "AH"
    events = F.sum(F.when(is_ah, F.col("n_events")))
    by_slot = state.groupBy("slot_no").agg(
        events.alias("n_events"),
        (F.sum(F.when(is_ah, F.col("n_events") * F.col("score"))) / events).alias("mean_score"),
        moments.merged(F.when(~is_ah, F.col("net_2b")))["mean"].alias("mean_rh_net"),
        moments.merged(F.when(is_ah, F.col("net_2b")))["mean"].alias("mean_ah_net"),
    )
    return slot_spine(state.sparkSession).join(by_slot, "slot_no", "left").na.fill(0, ["n_events"])


def slot_boxplot(state: DataFrame, reach: float = 1.5) -> DataFrame:
    """Box-plot figures of the scores per slot and signal, from at most eight counts per box."""
    boxes = state.withColumnRenamed("n_events", "n").groupBy("slot_no", "signal").agg(
        F.sum("n").alias("n_events"),
        (F.sum(F.col("n") * F.col("score")) / F.sum("n")).alias("mean"),
        F.expr("percentile(score, array(0.25, 0.5, 0.75), n)").alias("q"),
        F.collect_list(F.struct("score", "n")).alias("values"),
    )
    q1, q3 = F.col("q")[0], F.col("q")[2]
    low, high = q1 - reach * (q3 - q1), q3 + reach * (q3 - q1)
    inside = F.transform(
        F.filter("values", lambda v: (v["score"] >= low) & (v["score"] <= high)), lambda v: v["score"]
    )
    boxes = boxes.withColumn(
        "whisker_low", F.least(q1, F.array_min(inside).cast("double"))
    ).withColumn("whisker_high", F.greatest(q3, F.array_max(inside).cast("double")))
    outliers = F.aggregate(
        F.filter(
            "values",
            lambda v: (v["score"] < F.col("whisker_low")) | (v["score"] > F.col("whisker_high")),
        ),
        F.lit(0).cast("long"),
        lambda acc, v: acc + v["n"],
    )
    return boxes.join(slot_spine(state.sparkSession), "slot_no").select(
        "signal",
        "slot_no",
        "slot",
        "n_events",
        "mean",
        q1.alias("q1"),
        F.col("q")[1].alias("median"),
        q3.alias("q3"),
        "whisker_low",
        "whisker_high",
        outliers.alias("n_outliers"),
    )


def ttest_net(state: DataFrame) -> DataFrame:
    """One-sample t-test of the net effects against zero, per signal and baseline."""
    columns = [(s, b, f"{s}_{b}") for s in EDGES for b in BASELINES]
    found = state.agg(
        *[moments.merged(F.when(F.col("signal") == s, F.col(f"net_{b}"))).alias(c) for s, b, c in columns]
    )
    rows = [
        F.struct(
            F.lit(s).alias("signal"),
            F.lit(b).alias("baseline"),
            F.col(c)["n"].alias("n"),
            F.col(c)["mean"].alias("mean"),
            moments.stddev_samp(F.col(c)).alias("std"),
        )
        for s, b, c in columns
    ]
    t = F.try_divide(F.col("mean"), F.col("std") / F.sqrt("n"))
    nu = F.col("n") - 1
    return (
        found.select(F.inline(F.array(*rows)))
        .withColumn("t", t)
        .withColumn("nu", nu)
        .withColumn("p", student.two_sided_p(F.col("t"), F.col("nu")))
        .withColumn("log_p", -F.log10("p"))
    )


def pump_verdict(tests: DataFrame) -> DataFrame:
    """Verdict on AH and note on RH from the composite-baseline tests."""
    composite = tests.where(F.col("baseline") == "2b")
    is_rh = F.col("signal") == "RH"
    return composite.agg(
        F.max(F.when(is_rh, F.col("p"))).alias("p_rh"),
        F.max(F.when(~is_rh, F.col("p"))).alias("p_ah"),
        F.max(F.when(~is_rh, F.col("mean"))).alias("mean_ah"),
        F.max(F.when(~is_rh, F.col("n"))).alias("n_events"),
    ).select(
        "n_events",
        "p_rh",
        "p_ah",
        "mean_ah",
        scoring.verdict(F.col("p_ah"), F.col("mean_ah")).alias("verdict"),
        scoring.verdict_note(F.col("p_rh"), F.col("p_ah")).alias("note"),
    )


def minute_table(sensor_data: DataFrame, window: EventWindow = EventWindow()) -> DataFrame:
    return sr.minute_series(sensor_data, window.fill_limit)
