"""Connected components of an edge table by alternating star operations.

Edges are first contracted to stars in tasks of about ``TASK_EDGES`` edges (a
union-find inside each); then large-star and small-star steps, each a minimum
per node and a join, run until nothing changes - at once if one task held all
edges.  Every round is written to the shared folder, which cuts the lineage and
survives lost executors.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hygroflow.llm.tables import stored


#: Edges that one task contracts, about.
TASK_EDGES = 2_000_000


def _contracted(batches):
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if root(x) != x]
    yield pa.RecordBatch.from_pydict(
        {"u": pa.array(nodes, pa.int64()), "v": pa.array([root(x) for x in nodes], pa.int64())}
    )


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a long, b long) to (u, v): every node but the smallest of its component, and the smallest.

    ``edges`` is read twice, so it should be stored.
    """
    edges = edges.select("a", "b")
    tasks = 1 + edges.count() // TASK_EDGES
    current = stored(edges.coalesce(tasks).mapInArrow(_contracted, "u long, v long"), "stars")
    seen = None
    while tasks > 1:
        state = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
        current = stored(_small(_large(current)), "stars")
    return current
