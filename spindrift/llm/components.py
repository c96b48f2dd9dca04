"""Connected components of an edge table, by alternating star contractions.

Every round is a map and two groupings on the edges; the number of rounds
grows with the logarithm of the longest path.  Lineage is cut each round.  A
counted table of few edges is settled by one task instead, with equal results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _least(edges: DataFrame) -> DataFrame:
    """Node and the least of itself and its neighbours."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


#: So many edges (16 bytes each) are settled by one task.
ONE_TASK = 200_000


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find with the least node as root."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x, y = root(x), root(y)
            parent[max(x, y)] = min(x, y)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["node", "component"])


def settled(edges: DataFrame) -> DataFrame:
    """(node, component) of edges (u, v) without nulls that are known to be few: one task takes them all."""
    return edges.select("u", "v").coalesce(1).mapInArrow(_settle, "node long, component long")


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """(node, component): component is the least node that links reach.

    Edges may repeat, run either way, be loops, or have null ends (dropped).
    Nodes without an edge do not appear.  An empty table gives an empty result.
    """
    e = edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).dropna().where("u <> v").distinct()
    e = cut(e)
    if e.count() <= one_task:
        return settled(e)
    before = None
    for _ in range(rounds):
        # Large star: neighbours above a node go to the least of its neighbourhood.
        both = _both(e)
        large = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: neighbours below a node, and the node, go to the least of them.
        down = large.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        e = down.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
        e = cut(e.where("u <> v").distinct())
        # A forest of stars stays as it is; the sums tell.
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
