"""Zone-free time arithmetic on TIMESTAMP_NTZ columns.

``date_trunc``, ``unix_micros`` and friends work on zoned timestamps and would
make results depend on the session time zone.  The helpers below only use
fields of the zone-less timestamp, so two sessions with different zones agree,
and minute keys are plain integers that hash, sort and subtract cheaply.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTES_PER_DAY = 1440


def _epoch() -> Column:
    return F.lit("1970-01-01").cast("timestamp_ntz")


def _since_epoch(ts: Column, unit: str) -> Column:
    """Elapsed time in one unit.  ``ts`` occurs once: filters on the result stay cheap."""
    return (ts - _epoch()).cast(f"interval {unit}")


def minute_index(ts: Column) -> Column:
    """Whole minutes since 1970-01-01."""
    return _since_epoch(ts, "minute").cast("bigint")


def micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01."""
    return (_since_epoch(ts, "second").cast("decimal(18,6)") * 1_000_000).cast("bigint")


def second_of_minute(ts: Column) -> Column:
    """Seconds with microseconds as DECIMAL(8,6)."""
    return F.date_part(F.lit("SECOND"), ts)


def from_minute(minute: Column) -> Column:
    """Inverse of :func:`minute_index`."""
    return _epoch() + F.make_dt_interval(F.lit(0), F.lit(0), minute.cast("int"), F.lit(0))


def from_micros(us: Column) -> Column:
    """Inverse of :func:`micros`."""
    seconds = (us.cast("decimal(18,0)") / F.lit(1_000_000)).cast("decimal(18,6)")
    return _epoch() + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def shifted(ts: Column, hours: int) -> Column:
    """Stored time minus ``hours``: the local clock of an analysis."""
    return ts if hours == 0 else ts - F.expr(f"INTERVAL '{int(hours)}' HOUR")


def day_text(ts: Column) -> Column:
    """Calendar day as ``yyyy-MM-dd``."""
    return ts.cast("date").cast("string")


def bucket(ts: Column, width: str = "10 minutes") -> Column:
    """Start of the epoch-aligned tumbling window that holds ``ts``."""
    return F.window(ts, width).getField("start")


def hour_label(hour: Column) -> Column:
    return F.format_string("%02d:00", hour.cast("int"))
