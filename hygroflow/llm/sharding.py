"""Shards of near equal size that keep linked documents together.

Balanced label propagation.  Every document starts in a shard given by a hash.
In each round a Spark join tells every linked document how many bytes of its
group each shard holds; it wants to go where most are.  The bytes that want to
move from shard to shard (a table of shards squared, the only thing the driver
sees) are scaled down until no shard exceeds its quota, and that share of the
movers goes.  Links are rows (document, group), so a group of any size costs its
members, not its pairs; a group larger than a part of a shard is split first.
Documents without links then even out the sizes: they are counted by size class
(a few thousand classes whatever the input), the driver fills the shards by
class from large to small, and ranks inside a class say who goes where.

Draws go by row and round, so those who stayed in one round are free to go in
the next.  Rows are numbered when their sizes are stored; the numbers follow the
files read, so equal input files give equal shards.

Law: ``bytes``.  Defined cases: null text has no bytes (size 16) and links with
empty text; repeated rows are linked copies and each gets a slot of its own;
null identifiers are dealt like any other; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hygroflow.llm.tables import read, stored

SHARDS = 40
#: Bytes that a document costs besides its text.
OVERHEAD = 16
#: A group is split into parts of at most this share of a shard.
GROUP_SHARE = 0.25
ROUNDS = 5
#: Size classes per doubling of the size.
CLASSES = 32
#: Rows that are numbered together in one task, about.
NUMBERED = 4000


def _draw(round_no: int) -> Column:
    """A number in [0, 1) for each row, another one in every round."""
    return F.pmod(F.xxhash64(F.lit("draw"), F.lit(round_no), "row"), F.lit(1 << 30)) / float(1 << 30)


def numbered(df: DataFrame, keys: list[str], rows: int, name: str) -> DataFrame:
    """Number the rows of each key from 0 without gaps, in buckets that one task can hold."""
    df = df.withColumn("__bucket", F.pmod(F.xxhash64("row"), F.lit(1 + rows // NUMBERED)))
    counts = df.groupBy(*keys, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = Window.partitionBy(*keys, "__bucket").orderBy("row")
    ranked = df.withColumn("__rank", F.row_number().over(inside) - 1)
    return ranked.join(offsets, [*keys, "__bucket"]).withColumn(
        name, F.col("__before") + F.col("__rank")
    ).drop("__bucket", "__before", "__rank")


def flows(wanted: dict[tuple[int, int], float], loads: list[float], quota: float) -> dict[tuple[int, int], float]:
    """Share of each shard-to-shard flow that keeps every shard within its quota."""
    share = dict.fromkeys(wanted, 1.0)
    for _ in range(50):
        into, out = [0.0] * len(loads), [0.0] * len(loads)
        for (a, b), w in wanted.items():
            into[b] += w * share[a, b]
            out[a] += w * share[a, b]
        scale = [1.0] * len(loads)
        for j, load in enumerate(loads):
            if into[j] > 0 and load + into[j] - out[j] > max(quota, load):
                scale[j] = max(0.0, (max(quota, load) - load + out[j]) / into[j])
        if min(scale) > 0.999:
            break
        for a, b in share:
            share[a, b] *= scale[b]
    return share


def propagated(linked: DataFrame, shards: int, quota: float, rounds: int = ROUNDS) -> DataFrame:
    """Move linked documents (group, label, size, …) towards the shard that holds most of their group."""
    for round_no in range(rounds):
        held = linked.groupBy("group", "part", "label").agg(F.sum("size").alias("held"))
        best = held.groupBy("group", "part").agg(F.max_by("label", F.struct("held", -F.col("label"))).alias("target"))
        moves = linked.join(best, ["group", "part"])
        flow = moves.groupBy("label", "target").agg(F.sum("size").alias("bytes")).collect()  # shards squared
        loads, wanted = [0.0] * shards, {}
        for r in flow:
            loads[r["label"]] += r["bytes"]
            if r["label"] != r["target"]:
                wanted[r["label"], r["target"]] = float(r["bytes"])
        if not wanted:
            break
        share = flows(wanted, loads, quota)
        spark = linked.sparkSession
        rows = spark.createDataFrame([(a, b, s) for (a, b), s in share.items()], "label int, target int, share double")
        goes = _draw(round_no) < F.col("share")
        linked = stored(
            moves.join(F.broadcast(rows), ["label", "target"], "left")
            .withColumn("label", F.when(goes, F.col("target")).otherwise(F.col("label")))
            .drop("target", "share"),
            "labels",
        )
    return linked


def filled(classes: list[tuple[int, int, float]], loads: list[float]) -> list[tuple[int, int, int, int]]:
    """Fill shards with classes of (class, count, bytes each), the largest first.

    Returns (class, first rank, end rank, shard): each class raises the lowest
    shards to one common level.
    """
    loads, out = list(loads), []
    for name, count, each in sorted(classes, key=lambda c: -c[2]):
        order = sorted(range(len(loads)), key=lambda j: (loads[j], j))
        room, level = count * each, 0.0
        for k in range(1, len(order) + 1):
            level = (room + sum(loads[j] for j in order[:k])) / k
            if k == len(order) or level <= loads[order[k]]:
                break
        given = [max(0, math.floor((level - loads[j]) / each)) for j in range(len(loads))]
        for j in sorted(order, key=lambda j: (loads[j] + given[j] * each, j)) * 2:
            if sum(given) < count:
                given[j] += 1
        given[order[0]] += count - sum(given)
        at = 0
        for j, n in enumerate(given):
            if n:
                out.append((name, at, at + n, j))
                at += n
            loads[j] += n * each
    return out


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``docs`` (doc_id, text) with size, text_crc32, law, shard, slot and grown_shard."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    base = stored(
        docs.select(
            "doc_id",
            (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.sha2(text, 256).alias("text_key"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "sizes",
    )
    total = base.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    quota, rows = (total["bytes"] or 0) / shards, total["rows"]
    groups = (
        base.groupBy("text_key")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("group_bytes"))
        .where("n > 1")
        .select("text_key", F.ceil(F.col("group_bytes") / max(1.0, quota * GROUP_SHARE)).alias("parts"))
    )
    linked = (
        base.join(groups, "text_key")
        .withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")))
        .withColumn("group", F.col("text_key"))
        .withColumn("label", F.pmod(F.xxhash64(F.lit("start"), "row"), F.lit(shards)).cast("int"))
        .drop("parts")
    )
    columns = ["doc_id", "size", "text_crc32", "row", F.col("label").alias("shard")]
    settled = propagated(stored(linked, "labels"), shards, quota).select(*columns)
    loads = [0.0] * shards
    for r in settled.groupBy("shard").agg(F.sum("size").alias("bytes")).collect():  # one row per shard
        loads[r["shard"]] = float(r["bytes"])
    single = base.join(groups, "text_key", "left_anti").withColumn(
        "class", F.floor(F.log2(F.col("size").cast("double")) * CLASSES)
    )
    classes = [
        (r["class"], r["n"], r["bytes"] / r["n"])
        for r in single.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).collect()
    ]  # CLASSES rows per doubling of the size
    plan = docs.sparkSession.createDataFrame(
        filled(classes, loads), "class long, low long, high long, shard int"
    )
    ranked = numbered(single, ["class"], rows, "rank")
    evened = ranked.join(
        F.broadcast(plan),  # classes times shards
        (ranked["class"] == plan["class"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")),
    ).select("doc_id", "size", "text_crc32", "row", "shard")
    return numbered(settled.unionByName(evened), ["shard"], rows, "slot").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    return sharded(read(spark, folder, "documents", "doc_id", "text"))
