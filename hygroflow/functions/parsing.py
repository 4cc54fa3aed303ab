"""Typed values out of text columns, NULL where the text is not a value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_number(text: Column) -> Column:
    """``try_cast`` to DOUBLE without the Java-only spellings; finite numbers only.

    Java parses a type suffix (``1.5d``) and hexadecimal floats; SQL engines
    and dataframe libraries do not.  Replacing the letters those spellings need
    makes the cast fail.  The text is used once, so a filter on the number does
    not evaluate it several times, and no regular expression is involved.
    """
    return F.translate(text, "dDfFxX", "######").try_cast("double")


def to_number_or_infinity(text: Column) -> Column:
    """As :func:`to_number`, and infinite values keep their meaning."""
    word = F.lower(F.trim(text))
    infinite = F.when(word.isin("inf", "+inf", "infinity", "+infinity"), F.lit(float("inf"))).when(
        word.isin("-inf", "-infinity"), F.lit(float("-inf"))
    )
    return F.coalesce(to_number(text), infinite)


def to_number32(text: Column) -> Column:
    """Number with 32-bit rounding, carried on as DOUBLE."""
    return to_number(text).cast("float").cast("double")


def to_ts(text: Column) -> Column:
    return text.try_cast("timestamp_ntz")


def to_int(text: Column) -> Column:
    return F.trim(text).try_cast("int")


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)
