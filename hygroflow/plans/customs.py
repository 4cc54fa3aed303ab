"""Text filters on a customs export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hygroflow.functions import parsing
from hygroflow.settings import CustomsRule

# column names of the export, fixed by its publisher
DESCRIPTION = "C112 DESCRIPCION"
ORIGIN = "C115 COD. PAS ORIGEN"
CARGO = "C68 CD. TIPO CARGA"
DATA_TYPE = "C53 CD. TIPO DATOS"
FOB = "C72 VALOR TOTAL FOB U$"
REGIME = "C49 RGIMEN ADUANERO"
PACKAGING = "C106 COD. CLASE EMBALAJE"


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def has_text(column: Column, text: str) -> Column:
    """Case-insensitive literal search; a missing value does not match."""
    return F.coalesce(F.contains(F.lower(column), F.lit(text.lower())), F.lit(False))


def fob_value() -> Column:
    return parsing.nan_to_null(parsing.to_number_or_infinity(_col(FOB).cast("string")))


def predicates(rule: CustomsRule) -> dict[str, Column]:
    return {
        "description": has_text(_col(DESCRIPTION), rule.description),
        "origin": has_text(_col(ORIGIN), rule.origin),
        "cargo": has_text(_col(CARGO), rule.cargo),
        "data_type": has_text(_col(DATA_TYPE), rule.data_type),
        "fob": fob_value().isNotNull(),
        "regime": F.coalesce(
            parsing.to_number(_col(REGIME).cast("string")) == rule.regime, F.lit(False)
        ),
    }


def _all(tests: dict[str, Column]) -> Column:
    both = F.lit(True)
    for test in tests.values():
        both = both & test
    return both


def customs_filter(customs: DataFrame, rule: CustomsRule = CustomsRule()) -> DataFrame:
    return customs.where(_all(predicates(rule))).withColumn(FOB, fob_value())


def customs_boxes(filtered: DataFrame, rule: CustomsRule = CustomsRule()) -> DataFrame:
    return filtered.where(has_text(_col(PACKAGING), rule.packaging))


def customs_funnel(customs: DataFrame, rule: CustomsRule = CustomsRule()) -> DataFrame:
    """Row counts before and after every filter, in one pass."""
    tests = predicates(rule)
    kept = _all(tests)
    return customs.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(test).alias(f"n_{name}") for name, test in tests.items()],
        F.count_if(kept).alias("n_filtered"),
        F.count_if(kept & has_text(_col(PACKAGING), rule.packaging)).alias("n_boxes"),
    )
