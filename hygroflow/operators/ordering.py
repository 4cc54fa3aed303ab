"""A total order with gapless positions, without one task that sees all rows.

Rows are dealt by ranges of the sort key and sorted inside each range.  The
number of a row inside its range is known where it is sorted; one count per
range gives the offset.  Only these counts - as many as there are ranges - meet
in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hygroflow.session import stored

_ROW, _TIE = "__ordered_row", "__ordered_tie"


def positioned(rows: DataFrame, order: Sequence[Column], name: str = "position") -> DataFrame:
    """``rows`` with ``name`` = 1, 2, 3 ... in the given order.

    Rows that the order leaves equal keep their order of input, and they are
    spread over several ranges like any other rows.  The sorted rows are stored,
    so that counts and numbers come from the same layout.  An empty table gives
    no rows; a column of the same name as ``name`` is replaced.
    """
    columns = [F.col(f"`{c}`") for c in rows.columns if c != name]
    by = [*order, F.col(_TIE).asc()]
    numbered = rows.withColumn(_TIE, F.monotonically_increasing_id())
    ranged = numbered.repartitionByRange(*by).sortWithinPartitions(*by)
    laid = stored(ranged.select(*columns, F.monotonically_increasing_id().alias(_ROW)), "ordered")
    part, within = F.shiftright(_ROW, 33), F.col(_ROW).bitwiseAND(F.lit((1 << 33) - 1))
    sizes = laid.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    return (
        laid.withColumn("__part", part)
        .join(F.broadcast(offsets), "__part")  # one row per range
        .select(*columns, (F.col("__before") + within + 1).alias(name))
    )
