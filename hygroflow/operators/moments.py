"""Counts, means and squared deviations that can be merged.

A state is (n, mean, m2): m2 is the sum of squared deviations from the mean.
Two states merge without cancellation, whatever the size of the values, so a
table of small states per group answers every question about unions of groups.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def state(value: Column) -> Column:
    """Aggregate: the state of a group's values; missing values do not count."""
    n = F.count(value)
    return F.struct(n.alias("n"), F.avg(value).alias("mean"), (F.var_pop(value) * n).alias("m2"))


def weighted(found: Column, weight: Column) -> Column:
    """State of a group whose every row stands for ``weight`` equal rows."""
    return F.struct(
        (found["n"] * weight).alias("n"), found["mean"].alias("mean"), (found["m2"] * weight).alias("m2")
    )


def merged(states: Column) -> Column:
    """Aggregate: the state of the union.  For few states per group: they meet in one list."""
    empty = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("mean"), F.lit(None).cast("double").alias("m2"))
    # the order of the list must not decide the last digits
    return F.aggregate(F.array_sort(F.collect_list(F.when(states["n"] > 0, states))), empty, _joined)


def _joined(a: Column, b: Column) -> Column:
    n, gap = a["n"] + b["n"], b["mean"] - a["mean"]
    mean = a["mean"] + gap * b["n"] / n
    m2 = a["m2"] + b["m2"] + gap * gap * a["n"] * b["n"] / n
    first = a["n"] == 0
    return F.struct(
        n.alias("n"),
        F.when(first, b["mean"]).otherwise(mean).alias("mean"),
        F.when(first, b["m2"]).otherwise(m2).alias("m2"),
    )


def stddev_samp(found: Column) -> Column:
    return F.when(found["n"] > 1, F.sqrt(found["m2"] / (found["n"] - 1)))


def stddev_pop(found: Column) -> Column:
    return F.when(found["n"] > 0, F.sqrt(found["m2"] / found["n"]))
