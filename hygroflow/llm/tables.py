"""Small helpers that the operators of this folder share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hygroflow.session import stored

__all__ = ["stored", "read", "whole", "small_batches", "tested_bit", "bloom_words", "BLOOM_BLOCKS"]

#: Bytes of a batch on its way to Python inside ``small_batches``; one longer row makes a batch.
BATCH_BYTES = 4 << 20

#: One 64-bit word per block: a filter has this many rows of 16 bytes at most, unless sized to its keys.
BLOOM_BLOCKS = 1 << 16
#: Bounds of a filter sized to its keys, and keys per word: about 2 % false hits, more beyond 4 million keys.
LEAST_BLOCKS, MOST_BLOCKS = 1 << 10, 1 << 20
KEYS_PER_BLOCK = 4
BLOOM_PROBES = 4


def read(spark: SparkSession, folder: str, table: str, *columns: str) -> DataFrame:
    """The named columns of a whole table."""
    return spark.read.parquet(f"{folder}/{table}.parquet").select(*columns)


#: What a Python worker keeps for later tasks of one operator; workers are shared by all steps of a session.
_KEPT: dict[str, object] = {}


def kept_by_worker(name: str, make: Callable[[], object]):
    """What ``make`` builds, kept in this worker until a step of another operator begins in it."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = make()
    return _KEPT[name]


def forget_kept() -> None:
    """Drop what another operator has left in this worker."""
    _KEPT.clear()


def whole(df: DataFrame, per_batch: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Apply a function of one Arrow batch to all batches of all partitions."""

    def run(batches):
        forget_kept()
        for batch in batches:
            if batch.num_rows:
                yield from per_batch(batch)

    return df.mapInArrow(run, schema)


@contextmanager
def small_batches(spark: SparkSession, size: int = BATCH_BYTES) -> Iterator[None]:
    """What runs inside sends batches of about ``size`` bytes to Python, not 10,000 rows of any length.

    A batch is held several times, by the executor and by each of its workers.
    The session's own setting comes back at the end, so run the steps inside
    (``stored``) and not only plan them.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def blocks_for(keys: int) -> int:
    """Words of a filter for so many keys."""
    return min(MOST_BLOCKS, max(LEAST_BLOCKS, -(-keys // KEYS_PER_BLOCK)))


def _block(key: Column, blocks: int = BLOOM_BLOCKS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def tested_bit(key: Column) -> Column:
    """Bits of one block that a key sets: a few positions out of a second hash."""
    h = F.xxhash64(F.lit("bits"), key)
    mask = F.lit(0).cast("long")
    for i in range(BLOOM_PROBES):
        position = F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), position))
    return mask


def bloom_words(keys: DataFrame, column: str, blocks: int = BLOOM_BLOCKS) -> DataFrame:
    """Blocked Bloom filter of a key column: (block, word), at most ``blocks`` rows."""
    return (
        keys.where(F.col(column).isNotNull())
        .groupBy(_block(F.col(column), blocks).alias("__block"))
        .agg(F.bit_or(tested_bit(F.col(column))).alias("__word"))
    )


def possible(rows: DataFrame, column: str, words: DataFrame, blocks: int = BLOOM_BLOCKS) -> DataFrame:
    """Rows whose key may be in the filter; no row whose key is in it is lost.

    The filter is broadcast: it holds at most ``blocks`` rows, MOST_BLOCKS whatever the input.
    """
    marked = rows.withColumn("__block", _block(F.col(column), blocks))
    hit = marked.join(F.broadcast(words), "__block")
    mask = tested_bit(F.col(column))
    return hit.where(F.col("__word").bitwiseAND(mask) == mask).drop("__block", "__word")


def without(rows: DataFrame, column: str, dropped: DataFrame) -> DataFrame:
    """Rows whose key is not among ``dropped[column]``; rows with a null key stay.

    Rows that the filter of dropped keys rules out are passed on as they are, so
    that only possible hits, with their texts, are shuffled for the exact join.
    """
    keys = dropped.select(F.col(column).alias("__key")).where(F.col("__key").isNotNull())
    words = bloom_words(keys, "__key")
    mask = tested_bit(F.col(column))
    marked = rows.withColumn("__block", _block(F.col(column))).join(F.broadcast(words), "__block", "left")
    hit = F.coalesce(F.col("__word").bitwiseAND(mask) == mask, F.lit(False))
    clear = marked.where(~hit).drop("__block", "__word")
    checked = marked.where(hit).drop("__block", "__word")
    checked = checked.join(keys, checked[column] == keys["__key"], "left_anti")
    return clear.unionByName(checked).select(*rows.columns)
