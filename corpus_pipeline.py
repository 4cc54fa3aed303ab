"""The corpus pipeline: from raw documents to packed training sequences.

Five stages, each a function (spark, docs, sf_dir) that reads all its predecessor
kept.  All but the last return the columns of ``documents``: toxic documents go,
then copies, then all but the smallest identifier of each group of near copies
(words of five, similarity 0.8), then documents that contain a benchmark item.
The last one packs what is left into sequences.

Every filtering stage numbers the rows of a stored copy, gives its operator the
number and the text, and removes rows by number with columns alone.  So whole
documents never pass through Python, and rows without identifier or with a shared
one are judged by their own text; a row without identifier stays only where its
group has none with one.  Texts travel to Python in batches of ``tables.BATCH_BYTES``,
and files are read ``READ_ROWS`` rows at a time (``BOUNDS``, settings of the session,
which the stages make): what an executor touches once stays with it for all stages.

What a stage stores lies in one folder.  The next stage deletes it as soon as it
has stored its own copy; the last one's goes when the driver ends.  Empty tables
pass through every stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from threading import get_ident

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hygroflow.llm import decontamination, exact_dedup, jaccard_join, packing, toxicity
from hygroflow.llm.tables import BATCH_BYTES, read, stored, without
from hygroflow.session import Files, shared_folder, working_in

#: Rows of whole texts that a reader lays out at once; Spark's own 4,096 take tens of MB a task.
READ_ROWS = 512
BOUNDS = {
    "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES),
    "spark.sql.parquet.columnarReaderBatchSize": str(READ_ROWS),
}
#: Folder of the latest stage, by application and thread, so that pipelines side by side keep their own.
_LATEST: dict[tuple[str, int], str] = {}


def filtering(dropped: Callable[[SparkSession, DataFrame, str], DataFrame]):
    """A stage that removes the rows whose numbers ``dropped`` returns for the numbered documents."""

    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for name, value in BOUNDS.items():
            spark.conf.set(name, value)
        folder = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
        plain = [f"c{i}" for i in range(len(docs.columns))]  # no name of the documents can clash
        with working_in(folder):
            rows = stored(docs.toDF(*plain).withColumn("__row", F.monotonically_increasing_id()), "numbered")
            run_by = spark.sparkContext.applicationId, get_ident()
            if run_by in _LATEST:
                Files(spark).delete(_LATEST[run_by])
            _LATEST[run_by] = folder
            given = rows.select(*[F.col(plain[docs.columns.index(c)]).alias(c) for c in ("doc_id", "text")], "__row")
            gone = stored(dropped(spark, given, sf_dir).select("__row").distinct(), "dropped")
        return without(rows, "__row", gone).select(*[F.col(p).alias(c) for p, c in zip(plain, docs.columns, strict=True)])

    return stage


def others(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``groups`` (__row, group): all rows of a group but that of the smallest identifier; none goes last."""
    groups = stored(groups, "groups")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "__row")).alias("first")
    kept = groups.join(rows.select("__row", "doc_id"), "__row").groupBy("group").agg(first)
    return groups.select("__row").join(kept.select("first.__row"), "__row", "left_anti")


def toxic_rows(spark: SparkSession, rows: DataFrame, sf_dir: str) -> DataFrame:
    scorer = toxicity.Scorer(rows.select("doc_id", "text"), read(spark, sf_dir, "labels", "doc_id", "toxic"))
    return scorer.scored(rows.select("__row", "text"), "__row").where("score >= 0.5")


def copied_rows(spark: SparkSession, rows: DataFrame, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_groups(rows.select(F.col("__row").alias("doc_id"), "text"))
    return others(rows, groups.where("group_size > 1").select(F.col("doc_id").alias("__row"), F.col("keep_id").alias("group")))


def similar_rows(spark: SparkSession, rows: DataFrame, sf_dir: str) -> DataFrame:
    groups = jaccard_join.similar_groups(rows.select(F.col("__row").alias("doc_id"), "text"))
    return others(rows, groups.select(F.col("doc_id").alias("__row"), F.col("component_id").alias("group")))


def leaking_rows(spark: SparkSession, rows: DataFrame, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "benchmark", "text").withColumn("item_id", F.monotonically_increasing_id())
    found = decontamination.contaminated(rows.select(F.col("__row").alias("doc_id"), "text"), items)
    return found.select(F.col("doc_id").alias("__row"))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, packing.tokenizer_file())


toxicity_filter = filtering(toxic_rows)
exact_dedup_filter = filtering(copied_rows)
near_duplicate_filter = filtering(similar_rows)
decontamination_filter = filtering(leaking_rows)

STAGES = [
    ("toxicity", toxicity_filter),
    ("exact_dedup", exact_dedup_filter),
    ("ngram_jaccard_join", near_duplicate_filter),
    ("benchmark_decontamination", decontamination_filter),
    ("packing", packed_sequences),
]

#: Trees and a tokenizer are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
