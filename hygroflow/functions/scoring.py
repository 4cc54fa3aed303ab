"""Bins, labels, grades and classes as CASE expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from hygroflow.settings import SLOTS, SlopeRule


def score(net: Column, edges: Sequence[float]) -> Column:
    """Bin number 0..7 over half-open bins (lo, hi].

    A value that falls in no bin gets the top score: that holds for missing
    values, NaN and minus infinity as well as for values above the last edge.
    """
    top = len(edges)
    case = F.when(net.isNull() | F.isnan(net) | (net == F.lit(float("-inf"))), F.lit(top))
    for number, upper in enumerate(edges):
        case = case.when(net <= F.lit(float(upper)), F.lit(number))
    return case.otherwise(F.lit(top))


def score_label(number: Column, edges: Sequence[float], digits: int = 2) -> Column:
    """Printable range of a score bin."""
    top = len(edges)
    case = F.when(number == 0, F.lit("≤ 0"))
    for i in range(1, top):
        case = case.when(
            number == i, F.lit(f"{edges[i - 1]:.{digits}f} – {edges[i]:.{digits}f}")
        )
    return case.otherwise(F.lit(f"> {edges[-1]:.{digits}f}"))


def slot_number(hour: Column) -> Column:
    """Time-of-day slot 1..4; the last one takes whatever the others leave."""
    case = None
    for number, first, end, _ in SLOTS[:-1]:
        hit = (hour >= first) & (hour < end)
        case = F.when(hit, F.lit(number)) if case is None else case.when(hit, F.lit(number))
    return case.otherwise(F.lit(SLOTS[-1][0]))


def slot_label(number: Column) -> Column:
    case = None
    for n, _, _, label in SLOTS:
        case = (F if case is None else case).when(number == n, F.lit(label))
    return case


def grade(rate_pct: Column, good: float = 80, warn: float = 50) -> Column:
    return (
        F.when(rate_pct.isNull(), F.lit("none"))
        .when(rate_pct >= good, F.lit("good"))
        .when(rate_pct >= warn, F.lit("warn"))
        .otherwise(F.lit("bad"))
    )


def slope_class(delta: Column, relative_post: Column, rule: SlopeRule = SlopeRule()) -> Column:
    """0 / IF / IS / DF / DS; a missing slope fails every comparison and ends as DS."""
    rising = F.coalesce(relative_post > 0, F.lit(False))
    return (
        F.when(F.abs(delta) < rule.eps, F.lit("0"))
        .when(rising, F.when(delta > 0, F.lit("IF")).otherwise(F.lit("IS")))
        .otherwise(F.when(delta < 0, F.lit("DF")).otherwise(F.lit("DS")))
    )


def verdict(p_ah: Column, mean_ah: Column, alpha: float = 0.05, relevant: float = 0.30) -> Column:
    significant = F.coalesce(p_ah < alpha, F.lit(False))
    return (
        F.when(significant & (mean_ah > relevant), F.lit("RELEVANT"))
        .when(significant, F.lit("MARGINAL"))
        .otherwise(F.lit("NOT CONCLUSIVE"))
    )


def verdict_note(p_rh: Column, p_ah: Column, alpha: float = 0.05) -> Column:
    rh = F.coalesce(p_rh < alpha, F.lit(False))
    ah = F.coalesce(p_ah < alpha, F.lit(False))
    return (
        F.when(~rh & ah, F.lit("RH masked by temperature"))
        .when(~rh & ~ah, F.lit("neither signal significant"))
        .otherwise(F.lit("none"))
    )
