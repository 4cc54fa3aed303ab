"""Full refresh of a set of tables with every column as text."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hygroflow.sources.tables import Tables


def stringify(df: DataFrame) -> DataFrame:
    """All columns as text.  NULL stays NULL instead of turning into a word."""
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])


def copy_tables(tables: Tables, frames: Mapping[str, DataFrame]) -> dict[str, int]:
    """Replace every named table by the all-text copy of its frame and return the rows written.

    Each table changes by itself: a job lost between two tables leaves the first
    new and the second old, and running it again ends with all new.
    """
    return {name: tables.replace(name, stringify(df)).rows for name, df in frames.items()}


def snapshot_counts(frames: Mapping[str, DataFrame], tables: Tables | None = None) -> DataFrame:
    """Rows, cells with a value and characters of every table's all-text copy, as read back."""
    tables = tables or Tables(next(iter(frames.values())).sparkSession)
    copy_tables(tables, frames)
    parts = []
    for name in frames:
        copy = tables.scan(name)
        cells = [F.col(f"`{c}`") for c in copy.columns]
        parts.append(
            copy.agg(
                F.count(F.lit(1)).alias("n_rows"),
                reduce(lambda x, y: x + y, [F.count(c) for c in cells]).alias("n_cells"),
                reduce(lambda x, y: x + y, [F.coalesce(F.sum(F.length(c)), F.lit(0)) for c in cells]).alias("n_chars"),
            ).select(F.lit(name).alias("table_name"), "*")
        )
    return reduce(DataFrame.unionByName, parts)
