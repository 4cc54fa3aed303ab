"""Trie of conversation prefixes with counts of whole subtrees.

Every prefix of a conversation is named by a 128-bit digest that is chained from
turn to turn.  Prefixes are counted by digest (combined before the shuffle), which
gives the distinct nodes with their members.  A node that only one conversation
reaches needs no table: it has one leaf below it and saves nothing.  The shared
nodes are dealt to shards, each a set of whole subtrees, and each shard holds its
nodes in flat arrays: a minimal perfect hash of the digests gives every node a
slot (the digest stored there is compared, so an unknown digest is never taken for
a known one), counts are scattered into the slots and added to the parents' slots
from the deepest level up.

Sizes.  Let W be the number of (conversation, prefix) rows and ``limit`` =
max(``LEAST``, W / ``UPPER``).  Nodes with more than ``limit`` members are at most
``UPPER``, whatever the input; their keys are broadcast and their own table is one
shard.  Below them hang subtrees of at most ``limit`` conversations, several of
which share a shard.  Neither a first turn that a third of all conversations share
nor the root ever meets in one task with its rows: they arrive as counts.

The identifiers of conversations that end at one node are hashed in numeric order.
They are sorted by ranges of (node, identifier), written as texts of up to
``CHUNK`` identifiers where they are sorted, and streamed through the hash.

Texts leave the scan as digests.  A conversation is streamed in order of turns
with a state of a few values, however long it is.

Defined cases: rows without conversation identifier belong to no conversation and
are left out; null turns come first; rows of one turn follow role, the first 64
characters of the text and the digest of both; null roles and texts are empty;
repeated rows are turns of their own; an empty table gives no rows, not even a
root.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hygroflow.llm.tables import read, stored

#: Conversations of one family take their first turns from its first member.
FAMILY, MOST_SHARED = 5, 9
#: Nodes of the upper table at most; members that make a node an upper one at least.
UPPER, LEAST = 1 << 20, 256
#: Nodes of a shard, about; identifiers of a chunk; rows of an output batch.
SHARD, CHUNK, BATCH = 20_000, 4096, 50_000

ROOT = (0, 0)
PAIR = "<qq"
PATHS = "k1 long, k2 long, p1 long, p2 long, depth long, conv_id long, bytes long, last long"
TOTALS = "k1 long, k2 long, n_leaves long, saved_tokens long"


# -- paths ------------------------------------------------------------------
def _chained(family: int, most: int):
    """Rows sorted by family, its first member first, then by conversation and turn: one row per prefix."""

    def run(batches):
        out: list[tuple] = []
        group = conv = None
        first: list[tuple[bytes, int]] = []  # of the family's first member
        shared = own = depth = 0
        key, held = b"", None

        def step(content: bytes, size: int):
            nonlocal key, held, depth
            out.append((*held, 0))
            parent, key, depth = key, hashlib.sha256(key + content).digest()[:16], depth + 1
            held = (*struct.unpack(PAIR, key), *struct.unpack(PAIR, parent), depth, conv, size)

        for batch in batches:
            for base, c, content, size in zip(*[batch[n].to_pylist() for n in ("base", "conv_id", "content", "bytes")], strict=True):
                if base != group:
                    group, first = base, []
                if c != conv or held is None:
                    if held is not None:
                        out.append((*held, 1))
                    conv, key, depth, own = c, struct.pack(PAIR, *ROOT), 0, 0
                    held = (*ROOT, None, None, 0, c, 0)
                    shared = zlib.crc32(str(c).encode()) % most
                    if c != base:
                        for turn in first[:shared]:
                            step(*turn)
                if c == base and len(first) < most:
                    first.append((content, size))
                if c == base or own >= shared:
                    step(content, size)
                own += 1
                if len(out) >= BATCH:
                    yield _rows(out, PATHS)
                    out = []
        if held is not None:
            out.append((*held, 1))
            yield _rows(out, PATHS)

    return run


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int64() if c.endswith(" long") else pa.string() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def paths(conversations: DataFrame, family: int = FAMILY, most: int = MOST_SHARED) -> DataFrame:
    """``conversations`` (conv_id, turn, role, text): one row per prefix of each rebuilt conversation.

    Conversation c takes the first h = crc32(c) mod ``most`` turns of the family's
    first member c - c % family, then its own turns after the first h.  With
    ``family`` = 1 every conversation stays as it is.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    base = F.col("conv_id") - F.col("conv_id") % family
    content = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn"),
        role.alias("role"),
        F.substring(text, 1, 64).alias("head"),
        content.alias("content"),
        F.octet_length(text).cast("long").alias("bytes"),
        base.cast("long").alias("base"),
    )
    order = ["base", F.col("conv_id") != F.col("base"), "conv_id", F.col("turn").asc_nulls_first(), "role", "head", "content"]
    sorted_rows = rows.repartition("base").sortWithinPartitions(*order)
    return sorted_rows.select("base", "conv_id", "content", "bytes").mapInArrow(_chained(family, most), PATHS)


# -- node tables ------------------------------------------------------------
class Slots:
    """Minimal perfect hash of distinct 128-bit keys, checked against the stored keys.

    Keys that are alone in their place of a level's array stay there, the others
    go on to the next, smaller level; the slot is the number of places taken before.
    """

    def __init__(self, k1: np.ndarray, k2: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # taken, slot of the place
        self.k1, self.k2 = np.empty_like(k1), np.empty_like(k2)
        rest, used = np.arange(len(k1)), 0
        while len(rest):
            if len(self.levels) == 200:
                raise ValueError("keys are not distinct")
            place = self._place(k1[rest], k2[rest], len(self.levels), size := len(rest) * 2 + 1)
            taken = np.bincount(place, minlength=size) == 1
            slot = used + np.cumsum(taken) - 1
            alone = taken[place]
            at = slot[place[alone]]
            self.k1[at], self.k2[at] = k1[rest[alone]], k2[rest[alone]]
            self.levels.append((taken, slot))
            used += len(at)
            rest = rest[~alone]

    @staticmethod
    def _place(k1: np.ndarray, k2: np.ndarray, level: int, size: int) -> np.ndarray:
        h = k1.astype(np.uint64) ^ (k2.astype(np.uint64) * np.uint64(2 * level + 1))
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((h ^ (h >> np.uint64(32))) % np.uint64(size)).astype(np.int64)

    def __call__(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 for keys that are not in the table."""
        out, rest = np.full(len(k1), -1), np.arange(len(k1))
        for level, (taken, slot) in enumerate(self.levels):
            place = self._place(k1[rest], k2[rest], level, len(taken))
            hit = taken[place]
            out[rest[hit]] = slot[place[hit]]
            rest = rest[~hit]
        known = out >= 0
        known[known] = (self.k1[out[known]] == k1[known]) & (self.k2[out[known]] == k2[known])
        return np.where(known, out, -1)


def accumulated(nodes: pa.Table) -> pa.Table:
    """Nodes (k1, k2, p1, p2, depth, n_leaves, saved_tokens) of whole subtrees: sums over each node's subtree.

    A parent outside the table ends the way up.
    """
    column = {n: nodes[n].combine_chunks().fill_null(0).to_numpy() for n in nodes.column_names}
    slots = Slots(column["k1"], column["k2"])
    own, above = slots(column["k1"], column["k2"]), slots(column["p1"], column["p2"])
    above[column["depth"] == 0] = -1
    parent, depth = np.empty_like(own), np.empty_like(own)
    parent[own], depth[own] = above, column["depth"]
    sums = np.zeros((2, len(own)), np.int64)
    sums[0, own], sums[1, own] = column["n_leaves"], column["saved_tokens"]
    order = np.argsort(-depth, kind="stable")
    for level in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
        inside = level[parent[level] >= 0]
        for values in sums:
            np.add.at(values, parent[inside], values[inside])
    return pa.table({"k1": slots.k1, "k2": slots.k2, "n_leaves": sums[0], "saved_tokens": sums[1]})


def _subtree_sums(shared: DataFrame, steps: DataFrame) -> DataFrame:
    """Sums over the subtrees of shared nodes, in shards of bounded size."""
    counts = steps.agg(F.count(F.lit(1))).first()[0], shared.count()
    limit = max(LEAST, -(-counts[0] // UPPER))
    upper = shared.where(F.col("n_convs") > limit)
    lower = shared.where(F.col("n_convs") <= limit)
    # the topmost prefix of each conversation that is not an upper node names the subtree
    keys = F.broadcast(upper.select("k1", "k2"))  # at most UPPER rows, see above
    tops = steps.join(keys, ["k1", "k2"], "left_anti").groupBy("conv_id").agg(F.min(F.struct("depth", "k1", "k2")).alias("top"))
    shards = 1 + counts[1] // SHARD
    shard = F.pmod(F.xxhash64("top.k1", "top.k2"), F.lit(shards))
    needed = ["k1", "k2", "p1", "p2", "depth", "n_leaves", "saved_tokens"]
    dealt = lower.join(tops, "conv_id").select(shard.alias("shard"), *needed)
    sums = dealt.groupBy("shard").applyInArrow(accumulated_shard, TOTALS)
    sums = stored(sums, "trie-lower")
    # what the subtrees hand to the upper nodes they hang on, one row per upper node
    hung = lower.join(upper.select(F.col("k1").alias("p1"), F.col("k2").alias("p2")).hint("broadcast"), ["p1", "p2"])
    handed = (
        hung.select("k1", "k2", "p1", "p2")
        .join(sums, ["k1", "k2"])
        .groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2"))
        .agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
    )
    filled = upper.join(handed, ["k1", "k2"], "left").select(
        F.lit(0).cast("long").alias("shard"),
        "k1",
        "k2",
        "p1",
        "p2",
        "depth",
        (F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"),
        (F.col("saved_tokens") + F.coalesce("more_saved", F.lit(0))).alias("saved_tokens"),
    )
    return sums.unionByName(filled.groupBy("shard").applyInArrow(accumulated_shard, TOTALS)), upper, lower


def accumulated_shard(nodes: pa.Table) -> pa.Table:
    return accumulated(nodes.drop_columns(["shard"]))


# -- ends -------------------------------------------------------------------
def _chunks(batches):
    """Sorted rows (k1, k2, conv_id): texts of up to ``CHUNK`` identifiers of one node."""
    key, ids = None, []
    for batch in batches:
        out = []
        for k1, k2, c in zip(*[batch[n].to_pylist() for n in ("k1", "k2", "conv_id")], strict=True):
            if (k1, k2) != key or len(ids) == CHUNK:
                if ids:
                    out.append((*key, ids[0], ",".join(map(str, ids))))
                key, ids = (k1, k2), []
            ids.append(c)
        if out:
            yield _rows(out, "k1 long, k2 long, conv_id long, ids string")
    if ids:
        yield _rows([(*key, ids[0], ",".join(map(str, ids)))], "k1 long, k2 long, conv_id long, ids string")


def _hashed(batches):
    """Sorted chunks: the hash of each node's joined identifiers."""
    key, state = None, None
    for batch in batches:
        out = []
        for k1, k2, ids in zip(*[batch[n].to_pylist() for n in ("k1", "k2", "ids")], strict=True):
            if (k1, k2) == key:
                state.update(b",")
            else:
                if state:
                    out.append((*key, state.hexdigest()))
                key, state = (k1, k2), hashlib.sha256()
            state.update(ids.encode())
        if out:
            yield _rows(out, "k1 long, k2 long, ends_sha256 string")
    if state:
        yield _rows([(*key, state.hexdigest())], "k1 long, k2 long, ends_sha256 string")


def _ends(steps: DataFrame) -> DataFrame:
    order = ["k1", "k2", "conv_id"]
    ends = steps.where("last = 1").select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    chunks = ends.mapInArrow(_chunks, "k1 long, k2 long, conv_id long, ids string")
    chunks = chunks.repartition("k1", "k2").sortWithinPartitions(*order)
    return chunks.select("k1", "k2", "ids").mapInArrow(_hashed, "k1 long, k2 long, ends_sha256 string")


# -- the trie ---------------------------------------------------------------
def trie(steps: DataFrame) -> DataFrame:
    """``steps`` as ``paths`` returns them: one row per distinct prefix."""
    steps = stored(steps, "trie-paths")
    nodes = steps.groupBy("k1", "k2").agg(
        F.count(F.lit(1)).alias("n_convs"),
        *[F.min(c).alias(c) for c in ("conv_id", "depth", "p1", "p2", "bytes")],
    )
    nodes = stored(nodes, "trie-nodes")
    below = nodes.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
        F.count(F.lit(1)).alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("single")
    )
    zero = F.lit(0).cast("long")
    nodes = nodes.join(below, ["k1", "k2"], "left").withColumn("n_children", F.coalesce("n_children", zero))
    shared = nodes.where("n_convs > 1").select(
        "k1", "k2", "p1", "p2", "depth", "conv_id", "n_convs",
        # a child that one conversation reaches has one leaf below it, and saves nothing
        (F.coalesce("single", zero) + F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"),
    )
    shared = stored(shared, "trie-shared")
    sums, upper, lower = _subtree_sums(shared, steps)
    # parents with many children are broadcast; those found there ask for their own key in the second join
    high = upper.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("high_id"))
    low = lower.select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("conv_id").alias("low_id"))
    asked = nodes.join(F.broadcast(high), ["p1", "p2"], "left")
    found = F.col("high_id").isNotNull() | (F.col("depth") == 0)
    asked = asked.withColumn("a1", F.when(found, F.col("k1")).otherwise(F.col("p1")))
    asked = asked.withColumn("a2", F.when(found, F.col("k2")).otherwise(F.col("p2")))
    asked = asked.join(low, ["a1", "a2"], "left")
    whole_rows = asked.join(sums, ["k1", "k2"], "left").join(_ends(steps), ["k1", "k2"], "left")
    parent = F.coalesce("high_id", "low_id", "conv_id")
    return whole_rows.select(
        "conv_id",
        "depth",
        F.when(F.col("depth") > 0, parent).alias("parent_conv_id"),
        "n_convs",
        "n_children",
        F.coalesce("n_leaves", F.lit(1).cast("long")).alias("n_leaves"),
        F.coalesce("saved_tokens", zero).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    return trie(paths(read(spark, folder, "conversations", "conv_id", "turn", "role", "text")))


#: crc32 by its definition, a byte at a time.
ORACLE_SQL = r"""
WITH steps AS (
  SELECT b, list_reduce(list_prepend(b::UBIGINT, range(8)::UBIGINT[]), lambda c, i:
           CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END) AS v
  FROM range(256) t(b)),
crc_table AS (SELECT list(v ORDER BY b) AS v FROM steps),
own AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), substr(coalesce(text, ''), 1, 64),
                            sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
lengths AS (SELECT c, count(*) AS n, hex(encode(c::VARCHAR)) AS z FROM own GROUP BY c),
heads AS (
  SELECT c, n, xor(list_reduce(
           list_prepend(4294967295::UBIGINT, list_transform(range(len(z) // 2), lambda i:
             ('0x' || substr(z, (2 * i + 1)::BIGINT, 2))::UBIGINT)),
           lambda a, y: xor(a // 256, v[1 + xor(a % 256, y)::BIGINT])), 4294967295::UBIGINT)::BIGINT % 9 AS h
  FROM lengths, crc_table),
turns AS (
  SELECT heads.c, i AS d, r, x FROM heads JOIN own ON own.c = heads.c - heads.c % 5 AND i <= h
  UNION ALL
  SELECT heads.c, least(h, coalesce(b.n, 0)) + i - h, r, x
  FROM heads JOIN own ON own.c = heads.c AND i > h LEFT JOIN lengths b ON b.c = heads.c - heads.c % 5),
prefixes AS (
  SELECT c, d, strlen(x) AS bytes,
         sha256(string_agg(strlen(r) || ':' || r || strlen(x) || ':' || x, '') OVER (PARTITION BY c ORDER BY d)) AS k
  FROM turns
  UNION ALL SELECT c, 0, 0, '' FROM lengths),
linked AS (
  SELECT *, lag(k) OVER (PARTITION BY c ORDER BY d) AS p, lead(k) OVER (PARTITION BY c ORDER BY d) IS NULL AS last FROM prefixes),
nodes AS (
  SELECT k, any_value(p) AS p, any_value(d) AS d, any_value(bytes) AS bytes, min(c) AS c, count(*) AS n,
         sha256(coalesce(string_agg(CASE WHEN last THEN c::VARCHAR END, ',' ORDER BY c), '')) AS ends
  FROM linked GROUP BY k),
children AS (SELECT p AS k, count(*) AS n_children FROM nodes WHERE p IS NOT NULL GROUP BY p),
sums AS (
  SELECT prefixes.k, count(*) FILTER (n_children IS NULL) AS n_leaves, sum((n - 1) * nodes.bytes) AS saved
  FROM nodes LEFT JOIN children USING (k) JOIN prefixes ON prefixes.c = nodes.c AND prefixes.d <= nodes.d GROUP BY prefixes.k)
SELECT nodes.c AS conv_id, nodes.d AS depth, above.c AS parent_conv_id, nodes.n AS n_convs,
       coalesce(n_children, 0)::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, nodes.ends AS ends_sha256
FROM nodes JOIN sums USING (k) LEFT JOIN children USING (k) LEFT JOIN nodes above ON above.k = nodes.p
"""
