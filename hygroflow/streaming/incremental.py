"""Insert-if-absent loads of weather hours and executions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hygroflow.functions import clock, parsing
from hygroflow.sources.tables import Tables, Version

WEATHER = ["temperature_2m", "relative_humidity_2m", "rain", "surface_pressure", "wind_speed_10m"]


COPIES_PER_ROW = 1_000_000


def absent(rows: DataFrame, existing: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is not among ``existing``; a key with NULL is always absent.

    The existing side is reduced to its distinct keys before the shuffle.  Where
    the key is the whole row, copies are counted first (combined before the
    shuffle, rows without a key included), only distinct rows are joined, and
    the copies are laid out again in chunks spread over the cluster.
    """
    keys = list(on)
    known = existing.select(*keys).distinct()
    if set(keys) != set(rows.columns):
        return rows.join(known, keys, "left_anti").select(*rows.columns)
    new = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).join(known, keys, "left_anti")
    chunk = F.floor((F.col("_n") - 1) / COPIES_PER_ROW)
    left = F.col("_n") - F.col("_chunk") * COPIES_PER_ROW
    return (
        new.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), chunk)))
        .repartition(*keys, "_chunk")
        .withColumn(
            "_copy",
            F.explode(F.sequence(F.lit(1).cast("long"), F.least(left, F.lit(COPIES_PER_ROW)))),
        )
        .select(*rows.columns)
    )


# -- weather ----------------------------------------------------------------
def _slots(payload: DataFrame) -> DataFrame:
    """One row per position of the parallel arrays; ``steps`` is the length of the time axis, 0 if there is none."""
    micros = clock.micros(F.col("end")) - clock.micros(F.col("start"))
    steps = F.ceil(micros / (F.col("step_s").cast("long") * 1_000_000)).cast("int")
    has_axis = (F.col("step_s") > 0) & (F.col("end") > F.col("start"))
    axis = F.coalesce(F.when(has_axis, steps), F.lit(0))
    numbers = F.when(axis > 0, F.sequence(F.lit(0), axis - 1)).otherwise(F.array().cast("array<int>"))
    return payload.withColumn("steps", axis).select(
        "start", "end", "step_s", "steps", F.posexplode(F.arrays_zip(numbers.alias("i"), *[_array(v) for v in WEATHER])).alias("i", "h")
    )


def _array(name: str) -> Column:
    """A missing array has no values."""
    return F.coalesce(F.col(name), F.array().cast("array<double>")).alias(name)


def explode_payload(payload: DataFrame) -> DataFrame:
    """Parallel hourly arrays to rows; the time axis is closed on the left only.

    Positions beyond the axis have no time; ``payload_rejects`` returns them.
    """
    at = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("i") * F.col("step_s"))
    slots = _slots(payload).where(F.col("i") < F.col("steps"))
    return slots.select((F.col("start") + at).alias("datetime"), *[F.col(f"h.{v}").alias(v) for v in WEATHER])


def payload_rejects(payload: DataFrame) -> DataFrame:
    """Positions of the arrays that have no place on the time axis, with their values and the reason."""
    reason = F.when(F.col("steps") > 0, F.lit("beyond the axis")).otherwise(F.lit("no axis"))
    slots = _slots(payload).where(F.col("i") >= F.col("steps"))
    return slots.select(
        "start", "end", "step_s", F.col("i").alias("position"), reason.alias("reason"), *[F.col(f"h.{v}").alias(v) for v in WEATHER]
    )


def reject_counts(rejects: DataFrame) -> DataFrame:
    """Rejected positions per payload and reason, and how many of them hold a value."""
    held = F.coalesce(*[F.col(v) for v in WEATHER]).isNotNull()
    return rejects.groupBy("start", "reason").agg(
        F.count(F.lit(1)).alias("n_rejected"), F.count_if(held).alias("n_with_value"), F.min("position").alias("first_position")
    )


def weather_new_rows(payload: DataFrame, weather_hourly: DataFrame) -> DataFrame:
    return absent(explode_payload(payload), weather_hourly, ["datetime"])


def load_weather(tables: Tables, payload: DataFrame, source: str, batch: int, name: str = "weather_hourly") -> Version:
    """Insert the hours of one batch that the table lacks; a batch that came before adds nothing.

    What the time axis rejects goes to ``<name>_rejects`` under the same batch
    number, first, so that a job lost between the two writes is made whole by
    its repetition.  Usable as ``foreachBatch(lambda df, i: load_weather(tables, df, source, i))``.
    """
    tables.extend(f"{name}_rejects", lambda _: payload_rejects(payload), source, batch)

    def new_rows(state: DataFrame | None) -> DataFrame:
        return explode_payload(payload) if state is None else weather_new_rows(payload, state)

    return tables.extend(name, new_rows, source, batch)


# -- executions -------------------------------------------------------------
def executed_calendar(calendar: DataFrame) -> DataFrame:
    """Executed entries; the flag may be a number or its text."""
    return calendar.where(F.col("executed").cast("string").try_cast("double") == 1).select(
        "start_time", "execution_time"
    )


def schedule_runs(schedule_data: DataFrame, schedule: DataFrame) -> DataFrame:
    """Last execution of every schedule with its run time."""
    return schedule_data.join(schedule, "schedule_id").select(
        "schedule_id", "last_execution", "execution_time"
    )


def _typed(rows: DataFrame, start: str, source: str) -> DataFrame:
    return rows.select(
        F.lit(source).alias("_source"),
        parsing.to_ts(F.col(start).cast("string")).alias("start_time"),
        F.col("execution_time").cast("string").try_cast("long").alias("runtime"),
    )


def sync_executions(
    calendar: DataFrame, schedule_data: DataFrame, schedule: DataFrame, all_executions: DataFrame
) -> DataFrame:
    """Executions of both sources that are not recorded yet, without identifier.

    Both sources are tagged and compared in a single anti join on source, time
    and run time against the state before the run.
    """
    rows = _typed(executed_calendar(calendar), "start_time", "calendar").unionByName(
        _typed(schedule_runs(schedule_data, schedule), "last_execution", "schedule")
    )
    return absent(rows, all_executions, ["_source", "start_time", "runtime"])


def with_identifier(rows: DataFrame) -> DataFrame:
    """Add a fresh identifier per appended row."""
    return rows.select(F.uuid().alias("execution_id"), "*")


def load_executions(
    tables: Tables,
    calendar: DataFrame,
    schedule_data: DataFrame,
    schedule: DataFrame,
    name: str = "all_executions",
    source: str = "",
    batch: int | None = None,
) -> Version:
    """Append the executions that are not recorded yet, with their identifiers, as one change.

    The anti join reads one version of the table and the rows join exactly that
    version; if another job was quicker, they are made again from its result.
    """
    return tables.extend(
        name,
        lambda state: with_identifier(sync_executions(calendar, schedule_data, schedule, state)),
        source,
        batch,
    )
