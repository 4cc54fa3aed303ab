"""Benchmark items inside documents: size-partitioned MinHash containment search.

Items are partitioned by their number of distinct word n-grams into classes of
doubling size.  For a class with block size B, a document is read as windows of
two neighbouring blocks of B n-grams (the last window is what remains), so an
item never faces a set much larger than itself however long the document is.
One MinHash vector per window comes from the block minima; a window is a hit if
a value equals an item's at the same place.  A filter of the items' values, of
fixed size, keeps all other windows out of the shuffle; hits meet the items in a
hash join.  For every hit document the n-grams that may belong to some item go
along, and the exact containment - the share of the item's distinct n-grams that
occur anywhere in the document - decides.

With ``PROBES`` values a window whose Jaccard similarity with an item is s is
missed with probability (1 - s) ** PROBES; an item of containment 0.8 lying
together has s of at least 0.19 (0.3 to 0.6 as a rule), that is 0.99996 or more.
Items of at most half a block are found by any of their n-grams, which is exact.

Defined cases: null texts are empty; an item or document of fewer words than n
has its whole sequence as one n-gram; an item without words is in no document;
of repeated items each is reported, repeated (document, item) identifiers are
reported once with their best figures; rows without identifier are compared like any
other, but only pairs with both identifiers are reported; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hygroflow.llm import tables
from hygroflow.llm import words as wd
from hygroflow.llm.tables import stored

WORDS = 5
#: Share of an item's n-grams that must occur: NUM / DEN.
NUM, DEN = 80, 100
PROBES = 48
#: Size of the smallest block; classes double it.
BLOCK = 16
#: Class of items of at most half a block, whose windows are single n-grams.
TINY = -1
#: Bits of each of the two filters (MinHash values, n-grams of items): 4 MB whatever the items.
FILTER_BITS = 1 << 25

ORACLE_SQL = r"""
WITH w AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
s AS (
  SELECT kind, id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM w),
g AS (
  SELECT kind, id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS grams
  FROM s),
e AS (SELECT kind, id, len(grams) AS n, unnest(grams) AS gram FROM g)
SELECT d.id AS doc_id, i.id AS item_id, CAST(i.n AS BIGINT) AS item_shingles, count(*) AS common_shingles
FROM e i JOIN e d ON i.gram = d.gram AND i.kind = 'i' AND d.kind = 'd'
GROUP BY d.id, i.id, i.n HAVING 100 * count(*) >= 80 * i.n
"""

_rng = np.random.Generator(np.random.PCG64(20240502))
_TIMES = _rng.integers(1, 1 << 63, PROBES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _rng.integers(1, 1 << 63, PROBES, dtype=np.uint64)


def size_class(n: int) -> int:
    return TINY if n <= BLOCK // 2 else max(0, int(np.ceil(np.log2(n / BLOCK))))


def single(grams: np.ndarray) -> np.ndarray:
    """Keys of a tiny item: its n-grams themselves."""
    return wd.mixed(grams ^ np.uint64(0x5851F42D4C957F2D))


def minima(grams: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """MinHash values of consecutive runs of n-grams: runs times PROBES."""
    out = np.empty((len(heads), PROBES), np.uint64)
    for k in range(PROBES):
        out[:, k] = np.minimum.reduceat(grams * _TIMES[k] + _PLUS[k], heads)
    return out


def keys(values: np.ndarray, level: int) -> np.ndarray:
    """One 64-bit key per MinHash value, place and size class."""
    place = np.arange(PROBES, dtype=np.uint64) + np.uint64(1000 * (level + 1))
    return wd.mixed(values ^ (place * np.uint64(0x9E3779B97F4A7C15)))


def item_rows(batch: pa.RecordBatch):
    """Distinct n-grams and MinHash keys of every item."""
    sizes, levels, grams, found = [], [], [], []
    for _, h, bounds in wd.hashed(batch["text"]):
        for s in map(wd.distinct, wd.shingles(h, bounds, WORDS)):
            level = size_class(len(s))
            sizes.append(len(s))
            levels.append(level)
            grams.append(s)
            if not len(s) or level == TINY:
                found.append(single(s))
            else:
                found.append(keys(minima(s, np.zeros(1, np.int64)), level)[0])
    yield pa.RecordBatch.from_arrays(
        [batch["item_id"], pa.array(sizes, pa.int64()), pa.array(levels, pa.int32()), _longs(grams), _longs(found)],
        ["item_id", "n", "level", "grams", "keys"],
    )


def _longs(values: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0] + [len(v) for v in values])
    flat = np.concatenate(values).view(np.int64) if values else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


class Filter:
    """Bloom filter of 64-bit values in a bit table of fixed size."""

    def __init__(self, bits: int = FILTER_BITS):
        self.bits, self.table = bits, np.zeros(bits // 8, np.uint8)

    def _places(self, values: np.ndarray):
        for shift in (0, 32):
            at = ((values >> np.uint64(shift)) % np.uint64(self.bits)).astype(np.int64)
            yield at >> 3, (1 << (at & 7)).astype(np.uint8)

    def add(self, values: np.ndarray) -> None:
        for at, bit in self._places(values):
            np.bitwise_or.at(self.table, at, bit)

    def maybe(self, values: np.ndarray) -> np.ndarray:
        hit = np.ones(len(values), bool)
        for at, bit in self._places(values):
            hit &= (self.table[at] & bit) != 0
        return hit


def _merged_filter(items: DataFrame, column: str) -> Filter:
    """Filter of all values of a list column, from a few partial filters of the same fixed size."""

    def part(batches):
        made = Filter()
        for batch in batches:
            made.add(batch[column].flatten().to_numpy().view(np.uint64))
        yield pa.RecordBatch.from_pydict({"bits": pa.array([made.table.tobytes()], pa.binary())})

    few = items.select(column).coalesce(8)  # eight tables of FILTER_BITS at most
    out = Filter()
    for row in few.mapInArrow(part, "bits binary").toLocalIterator():
        out.table |= np.frombuffer(row["bits"], np.uint8)
    return out


def _hits(shared, levels: list[int]):
    """Documents with a window that may match: its keys, and its n-grams that may belong to items."""

    def one(batch: pa.RecordBatch):
        known_keys, known_grams = shared.value
        at, found, grams = [], [], []
        for first, h, bounds in wd.hashed(batch["text"]):
            sets = list(wd.shingles(h, bounds, WORDS))
            for row, hit in _windows_that_hit(sets, levels, known_keys):
                at.append(first + row)
                found.append(hit)
                mine = wd.distinct(sets[row])
                grams.append(mine[known_grams.maybe(mine)])
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"].take(pa.array(at, pa.int64())), _longs(found), _longs(grams)], ["doc_id", "keys", "grams"]
        )

    return one


def _windows_that_hit(sets: list[np.ndarray], levels: list[int], known: Filter):
    """(text, keys) of the texts with a window that may match an item; all texts' windows are tried at once."""
    sizes = np.array([len(s) for s in sets])
    blocks = -(-sizes // BLOCK)
    if not blocks.sum():
        return
    text = np.repeat(np.arange(len(sets)), blocks)
    number = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)  # of a block in its text
    values = minima(np.concatenate(sets), (np.cumsum(sizes) - sizes)[text] + number * BLOCK)
    owners, hits = [], []
    if TINY in levels:
        every = single(np.concatenate(sets))
        maybe = np.flatnonzero(known.maybe(every))
        owners.append(np.repeat(np.arange(len(sets)), sizes)[maybe])
        hits.append(every[maybe])
    for level in range(levels[-1] + 1):
        if level:  # neighbouring blocks become one
            number = number // 2
            heads = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (number[1:] != number[:-1]))))
            values, text, number = np.minimum.reduceat(values, heads, axis=0), text[heads], number[heads]
        if level in levels:
            window = values.copy()
            on = np.flatnonzero(text[1:] == text[:-1])
            window[on] = np.minimum(values[on], values[on + 1])
            every = keys(window, level)
            maybe = np.flatnonzero(known.maybe(every.ravel()))
            owners.append(text[maybe // PROBES])
            hits.append(every.ravel()[maybe])
    owner, hit = np.concatenate(owners), np.concatenate(hits)
    for row in np.unique(owner).tolist():
        yield row, np.unique(hit[owner == row])


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text), ``items`` (item_id, text): one row per document and item that it contains."""
    spark = docs.sparkSession
    about = tables.whole(
        items.select("item_id", "text"), item_rows,
        f"item_id {dict(items.dtypes)['item_id']}, n long, level int, grams array<long>, keys array<long>",
    ).where("n > 0")
    about = stored(about.withColumn("item", F.monotonically_increasing_id()), "items")
    levels = sorted(r["level"] for r in about.select("level").distinct().collect())  # one per doubling of item size
    kind = dict(docs.dtypes)["doc_id"]
    if not levels:
        return spark.createDataFrame([], f"doc_id {kind}, item_id long, item_shingles long, common_shingles long")
    filters = (_merged_filter(about, "keys"), _merged_filter(about, "grams"))
    shared = spark.sparkContext.broadcast(filters)  # two tables of FILTER_BITS
    hits = tables.whole(
        docs.select("doc_id", "text"), _hits(shared, levels), f"doc_id {kind}, keys array<long>, grams array<long>"
    )
    hits = stored(hits.withColumn("hit", F.monotonically_increasing_id()), "hits")
    item_keys = about.select("item", F.explode("keys").alias("key"))
    pairs = hits.select("hit", F.explode("keys").alias("key")).join(item_keys, "key").select("hit", "item").distinct()
    grams = hits.select("hit", F.explode("grams").alias("gram"))
    wanted = about.select("item", F.explode("grams").alias("gram"))
    common = (
        pairs.join(wanted, "item").join(grams, ["hit", "gram"]).groupBy("hit", "item").agg(F.count(F.lit(1)).alias("common"))
    )
    found = common.join(about.select("item", "item_id", "n"), "item").where(f"{DEN} * common >= {NUM} * n")
    return (
        found.join(hits.select("hit", "doc_id"), "hit")
        .where("doc_id IS NOT NULL AND item_id IS NOT NULL")
        .groupBy("doc_id", "item_id")
        .agg(F.max_by("n", "common").alias("item_shingles"), F.max("common").alias("common_shingles"))
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(
        tables.read(spark, folder, "documents", "doc_id", "text"), tables.read(spark, folder, "benchmark", "item_id", "text")
    )
