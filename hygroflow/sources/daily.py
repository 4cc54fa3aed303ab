"""Logs by day: times are read once, at loading, and a time window opens only its days.

The raw logs keep their times as text, so every question about a window would
parse the text of the whole log.  ``load`` parses it once, adds ``ts`` and ``day``
and lays the rows out by day in a versioned table.  ``between`` puts the window
on the day as well, which Spark answers from folder names, and ``on_days_of``
joins on the day, so that Spark opens the days that the other side turns out to
have (dynamic partition pruning).

Rows whose time cannot be read have no day.  They go to a second table with their
text, in the same batch, so that loaded and rejected rows add up to the log.
"""

from __future__ import annotations

from datetime import date, datetime, time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hygroflow.functions.parsing import to_ts
from hygroflow.sources.tables import Tables

BY = ("day",)


def rejects_of(name: str) -> str:
    return f"{name}_rejected"


def timed(log: DataFrame, text_column: str) -> DataFrame:
    """The log with ``ts`` and ``day`` in the place of its text column; both are null where it cannot be read."""
    ts = to_ts(F.col(f"`{text_column}`"))
    others = [F.col(f"`{c}`") for c in log.columns if c not in (text_column, "ts", "day")]
    return log.select(*others, ts.alias("ts")).withColumn("day", F.to_date("ts"))


def load(tables: Tables, name: str, log: DataFrame, text_column: str, source: str = "log", batch: int | None = None) -> None:
    """Append a log to the table ``name`` by day, and what has no time to ``rejects_of(name)``.

    A batch that came before adds nothing to either table.  A job lost between
    the two leaves the rejects without the rows; the repeated batch then brings
    only these.  Columns of the log named ``ts`` or ``day`` make way for those
    of the table.
    """
    unread = log.where(to_ts(F.col(f"`{text_column}`")).isNull())
    tables.extend(rejects_of(name), lambda _: unread, source, batch)
    rows = timed(log, text_column).where(F.col("ts").isNotNull())
    tables.extend(name, lambda _: rows, source, batch, BY)


def _moment(text: str) -> datetime:
    return datetime.fromisoformat(text)


def between(log: DataFrame, start: str, end: str | None = None) -> DataFrame:
    """Rows of a loaded log in the half-open window [start, end); without an end, from ``start`` on."""
    first = _moment(start)
    kept = log.where((F.col("day") >= F.lit(first.date())) & (F.col("ts") >= F.lit(first).cast("timestamp_ntz")))
    if end is None:
        return kept
    last = _moment(end)
    return kept.where((F.col("day") <= F.lit(_last_day(last))) & (F.col("ts") < F.lit(last).cast("timestamp_ntz")))


def _last_day(end: datetime) -> date:
    """The last day with a moment before ``end``."""
    return end.date() if end.time() > time.min else date.fromordinal(end.toordinal() - 1)


def on_days_of(log: DataFrame, events: DataFrame, column: str = "ts") -> DataFrame:
    """Rows of a loaded log on the days that ``events`` fall on."""
    days = events.select(F.to_date(column).alias("day")).where("day IS NOT NULL").distinct()
    return log.join(days, "day", "left_semi").select(*log.columns)
