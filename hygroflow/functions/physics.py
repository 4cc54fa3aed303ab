"""Humidity formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hygroflow.settings import MAGNUS


def absolute_humidity(temp_c: Column, rh_pct: Column) -> Column:
    """Water vapour in g/m³ from °C and % relative humidity (Magnus approximation)."""
    saturation = F.lit(MAGNUS["es0"]) * F.exp(
        F.lit(MAGNUS["a"]) * temp_c / (temp_c + F.lit(MAGNUS["b"]))
    )
    return (
        F.lit(MAGNUS["k"]) * (rh_pct / F.lit(100.0)) * saturation / (temp_c + F.lit(MAGNUS["zero_c"]))
    )
