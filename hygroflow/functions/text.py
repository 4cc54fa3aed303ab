"""Company name normalisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hygroflow.settings import LEGAL_SUFFIXES


def normalized(raw: Column) -> Column:
    """Lower case, ``&`` spelled out, punctuation and legal suffixes removed, single spaces.

    ``(?U)`` makes the word class cover all scripts, not ASCII only.
    """
    text = F.regexp_replace(F.lower(raw), "&", " and ")
    text = F.regexp_replace(text, r"(?U)[^\w\s]", " ")
    words = F.split(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), " ")
    return F.array_join(F.filter(words, lambda w: ~w.isin(*LEGAL_SUFFIXES)), " ")


def acronym(norm: Column) -> Column:
    """First characters of the words."""
    return F.array_join(F.transform(F.split(norm, " "), lambda w: F.substring(w, 1, 1)), "")


def block_key(norm: Column, chars: int = 4) -> Column:
    return F.substring(norm, 1, chars)


def containment(a: Column, b: Column) -> Column:
    """Length ratio when one text holds the other; two empty texts give 0."""
    shorter, longer = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    held = (F.contains(a, b) | F.contains(b, a)) & (longer > 0)
    return F.when(held, shorter / longer).otherwise(F.lit(0.0))


def acronyms_agree(norm_a: Column, norm_b: Column, acr_a: Column, acr_b: Column) -> Column:
    return (acr_a == norm_b) | (acr_b == norm_a) | (acr_a == acr_b)
