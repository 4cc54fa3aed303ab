"""Exact duplicates by content sort.

Texts are normalised (each run of ASCII white space becomes one space; null is
empty), dealt to ranges of (leading bytes, SHA-256 of the normalised text,
identifier) by Spark's sampled splitters, and sorted inside every range by
Spark's external sort.  Equal texts are then neighbours; one pass over the
sorted rows compares each normalised text with the one before in full and keeps
the smallest identifier.  The key is of fixed length because splitters pass
through the driver.  As it ends with the identifier, a group of any size spreads
over as many ranges as its rows need; runs that touch the edge of a range are
compared in full with the neighbouring range's edge and joined.

Defined cases: an empty table gives no rows; null and empty texts are one group;
of rows with equal text *and* equal identifier exactly one is kept; rows with a
null identifier come last in their group, so they are kept only if the whole
group has none.  Other columns are carried in one struct and cannot clash.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hygroflow.llm.tables import read, stored

#: Bytes of a text at the front of the sort key.
LEADING = 32

ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""


def normalised(text: Column) -> Column:
    """Single spaces stay untouched, so that only the other white space costs a match."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D\x20]{2,}|[\x09-\x0D]", " ")


def _runs(with_row: bool):
    """Pass over sorted rows that closes one run of equal texts after the other."""

    def run(batches):
        part = TaskContext.get().partitionId()
        number, text, held = 0, None, []

        def emit(ids, lead, keep, size, sha, runs, edge, rows):
            n = len(ids)
            columns = [ids, lead, keep, size, sha, pa.array([part] * n, pa.int32()), runs, edge]
            names = ["doc_id", "lead", "keep_id", "group_size", "text_sha256", "part", "run", "edge"]
            if with_row:
                columns, names = columns + [rows], names + ["row"]
            out = pa.RecordBatch.from_arrays(columns, names)
            return out.filter(pc.or_(out["lead"], pc.is_valid(out["edge"]))) if with_row else out

        def flush(is_edge: bool):
            ids = pa.concat_arrays([b["doc_id"] for b in held])
            n = len(ids)
            only_first = pa.array([True] + [False] * (n - 1))
            rows = None
            if with_row:
                first = held[0].slice(0, 1)
                ids, n, rows = ids.slice(0, 1), 1, first["row"]
                only_first = pa.array([True])
            size = sum(b.num_rows for b in held)
            return emit(
                ids,
                only_first,
                pa.array([ids[0].as_py()] * n, pa.int64()),
                pa.array([size] * n, pa.int64()),
                pa.array([held[0]["sha"][0].as_py()] * n, pa.string()),
                pa.array([number] * n, pa.int64()),
                pa.array(([text] if is_edge else [None]) + [None] * (n - 1), pa.string()),
                rows,
            )

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            texts = batch["norm"]
            same = [text is not None and texts[0].as_py() == text]
            same += pc.equal(texts.slice(1), texts.slice(0, n - 1)).to_pylist()
            starts = [i for i, s in enumerate(same) if not s]
            light = batch.drop_columns(["norm"])
            if not starts:
                held.append(_ids(light) if with_row else light)
                continue
            if starts[0]:
                rest = light.slice(0, starts[0])
                held.append(_ids(rest) if with_row else rest)
            if held:
                yield flush(number == 0)
                number += 1
            first, last = starts[0], starts[-1]
            if last > first and number == 0:  # the first run of this range ends here
                held, text = [light.slice(first, starts[1] - first)], texts[first].as_py()
                yield flush(True)
                number, starts = 1, starts[1:]
                first = starts[0]
            if last > first:
                sizes = [b - a for a, b in zip(starts[:-1], starts[1:], strict=True)]
                at = pa.array([a - first for a, s in zip(starts, sizes, strict=False) for _ in range(s)])
                middle = light.slice(first, last - first)
                yield emit(
                    middle["doc_id"],
                    pa.array([i == 0 for s in sizes for i in range(s)], pa.bool_()),
                    middle["doc_id"].take(at),
                    pa.array([s for s in sizes for _ in range(s)], pa.int64()),
                    middle["sha"],
                    pa.array([number + k for k, s in enumerate(sizes) for _ in range(s)], pa.int64()),
                    pa.nulls(len(middle), pa.string()),
                    middle["row"] if with_row else None,
                )
                number += len(sizes)
            held, text = [light.slice(last)], texts[last].as_py()
        if held:
            yield flush(True)

    return run


def _ids(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Without the carried rows, which only the first row of a run needs."""
    return batch.drop_columns(["row"])


def _marked(docs: DataFrame, with_row: bool) -> DataFrame:
    """Rows with the run of equal texts they lie in, joined across ranges."""
    norm = normalised(F.col("text"))
    kept = [F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")]
    if with_row:
        kept = [kept[0], F.col("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")]
    keyed = docs.select(
        *kept,
        F.sha2(norm.cast("binary"), 256).alias("sha"),
        F.substring(norm.cast("binary"), 1, LEADING).alias("head"),
    )
    order = [F.col("head"), F.col("sha"), F.col("doc_id").asc_nulls_last()]
    columns = ["doc_id", "sha", "norm"] + ["row"] * with_row
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = (
        "doc_id long, lead boolean, keep_id long, group_size long, text_sha256 string,"
        " part int, run long, edge string"
    )
    if with_row:
        ranged = ranged.drop("text").withColumn("text", F.col("row.text"))
        kind = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).schema
        schema += f", row {kind['row'].dataType.simpleString()}"
    sorted_rows = ranged.withColumn("norm", norm).select(*columns)
    runs = stored(sorted_rows.mapInArrow(_runs(with_row), schema), "exact-runs")
    chains = F.broadcast(_chains(runs))  # two rows per range at most
    return (
        runs.drop("edge")
        .join(chains, ["part", "run"], "left")
        .select(
            "doc_id",
            F.when(F.col("linked"), F.col("chain_keep")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("chain_size", "group_size").alias("group_size"),
            (F.col("lead") & F.coalesce("chain_head", F.lit(True))).alias("kept"),
            "text_sha256",
            *(["row"] if with_row else []),
        )
    )


def _chains(runs: DataFrame) -> DataFrame:
    """Runs at the edges of ranges with the group they belong to across ranges.

    Two rows per range at most, so the windows without partition stay as small
    as the number of shuffle partitions; texts are compared in a join.
    """
    edges = runs.where(F.col("edge").isNotNull()).select("part", "run", "keep_id", "group_size", "edge")
    span = edges.groupBy("part").agg(F.min("run").alias("low"), F.max("run").alias("high"))
    span = span.withColumn("seq", F.row_number().over(Window.orderBy("part")))
    edges = edges.join(span, "part")
    last = edges.where(F.col("run") == F.col("high")).select(
        (F.col("seq") + 1).alias("seq"), F.col("edge").alias("before")
    )
    first = edges.where(F.col("run") == F.col("low")).select("part", "run", "seq", "edge")
    going_on = first.join(last, "seq").where(F.col("edge") == F.col("before")).select("part", "run", F.lit(True).alias("same"))
    rows = edges.select("part", "run", "keep_id", "group_size").join(going_on, ["part", "run"], "left")
    new = F.when(F.col("same"), 0).otherwise(1)
    rows = rows.withColumn("chain", F.sum(new).over(Window.orderBy("part", "run")))
    group = Window.partitionBy("chain")
    return rows.select(
        "part",
        "run",
        F.lit(True).alias("linked"),
        F.min("keep_id").over(group).alias("chain_keep"),
        F.sum("group_size").over(group).alias("chain_size"),
        F.col("same").isNull().alias("chain_head"),
    )


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    return _marked(docs.select("doc_id", "text"), with_row=False)


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns."""
    return _marked(docs, with_row=True).where("kept").select("row.*")


def query(spark: SparkSession, folder: str) -> DataFrame:
    return exact_groups(read(spark, folder, "documents", "doc_id", "text"))
