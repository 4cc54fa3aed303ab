"""Exact grouped quantiles that never hold a whole group in one task.

``percentile``/``median`` keep every distinct value of a group in one
aggregation buffer.  That is fine for small groups and breaks when one minute,
day or offset holds a large part of the data.  The plan below is exact and
splits such groups:

1. count equal values (map-side combined, keyed by group *and* value),
2. cut the value axis of every group into bands, a fixed number per power of
   two, and count the bands: a few hundred rows per group however large it is,
3. find the bands that hold the wanted ranks from the cumulative band counts,
4. rank single values only inside those bands.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BANDS_PER_OCTAVE = 64
_OFFSET = 1100  # lifts every binary exponent of a double above zero


def value_band(value: str, per_octave: int = BANDS_PER_OCTAVE) -> str:
    """SQL for an integer that never decreases with ``value``; equal steps within a power of two.

    A rounding slip of ``log2`` next to a power of two is harmless: the linear
    part then starts below 0 or ends at 1 and lands on the same band.
    """
    octave = f"floor(log2(abs({value})))"
    band = (
        f"(({octave} + {_OFFSET}) * {per_octave}"
        f" + floor((abs({value}) / pow(2.0D, {octave}) - 1) * {per_octave}))"
    )
    # never NULL: a join on the band must not add filters to one side only, or the
    # two readers of the counts stop sharing their shuffle
    return f"coalesce(CASE WHEN {value} > 0 THEN {band} WHEN {value} < 0 THEN -{band} END, 0L)"


def grouped_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    weight: str | None = None,
) -> DataFrame:
    """Linear-interpolated quantiles of ``value`` per ``keys``.

    ``probs`` maps output names to probabilities.  ``weight`` is a whole number
    of repetitions per row.  Rows with a missing value do not count; groups
    with missing values only give no row.
    """
    group = ", ".join(keys)
    upto = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    # names, whole ranks below and above the wanted position, and the way between them
    ranks = [
        (name, f"floor({p!r}D * (_total - 1))", f"ceil({p!r}D * (_total - 1))", f"{p!r}D * (_total - 1)")
        for name, p in probs.items()
    ]

    counted = (
        df.where(f"{value} IS NOT NULL AND NOT isnan({value})")
        .groupBy(*keys, F.col(value).alias("_v"))
        .agg(F.expr(f"sum({weight}) AS _n" if weight else "count(1) AS _n"))
        .withColumn("_band", F.expr(value_band("_v")))
    )
    wanted = " OR ".join(
        f"({r} >= _end - _bn AND {r} < _end)" for _, lo, hi, _ in ranks for r in (lo, hi)
    )
    bands = (
        counted.groupBy(*keys, "_band")
        .agg(F.expr("sum(_n) AS _bn"))
        .selectExpr(
            "*",
            f"sum(_bn) OVER (PARTITION BY {group} ORDER BY _band {upto}) AS _end",
            f"sum(_bn) OVER (PARTITION BY {group}) AS _total",
        )
        .where(wanted)
        .selectExpr(*keys, "_band", "_end - _bn AS _start", "_total")
    )
    placed = counted.join(bands, [*keys, "_band"]).selectExpr(
        *keys,
        "_v",
        "_n",
        "_total",
        f"_start + sum(_n) OVER (PARTITION BY {group}, _band ORDER BY _v {upto}) AS _to",
    )
    picks = [
        f"max(CASE WHEN {r} >= _to - _n AND {r} < _to THEN _v END) AS _{tag}{i}"
        for i, (_, lo, hi, _) in enumerate(ranks)
        for tag, r in (("lo", lo), ("hi", hi))
    ]
    found = placed.groupBy(*keys).agg(
        F.expr("first(_total) AS _total"), *[F.expr(pick) for pick in picks]
    )
    return found.selectExpr(
        *keys,
        *[
            f"_lo{i} + (_hi{i} - _lo{i}) * ({pos} - {lo}) AS {name}"
            for i, (name, lo, _, pos) in enumerate(ranks)
        ],
    )


def grouped_median(
    df: DataFrame, keys: Sequence[str], value: str, name: str, weight: str | None = None
) -> DataFrame:
    return grouped_quantiles(df, keys, value, {name: 0.5}, weight)
