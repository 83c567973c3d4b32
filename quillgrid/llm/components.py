"""Connected components of a graph given as rows, without gathering it anywhere."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.common import Batches, cut, tidied
from quillgrid.session import ship_package

#: Rounds after which something must be wrong: their number grows with the logarithm of the longest path.
MAX_ROUNDS = 100


#: Edges that one task contracts at a time.
TASK_EDGES = 250_000


def _contracted(batches: Batches) -> Batches:
    """Stars with the same components as the edges of a partition (of stretches of it, where it is large)."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := root.get(top, top)) != top:
            top = up
        while (up := root.get(x, x)) != top:
            root[x], x = top, up
        return top

    def stars() -> pa.RecordBatch:
        found = [(x, y) for x in root if (y := find(x)) != x]
        root.clear()
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["u", "v"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
        if len(root) > TASK_EDGES:
            yield stars()
    yield stars()


def _mark(edges: DataFrame):
    return edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each component, for every node that has an edge to another.

    ``edges`` has columns a and b. Each partition's edges are first reduced to stars where they are, and
    again after putting partitions together up to ``TASK_EDGES`` edges a task; then large-star and
    small-star rounds alternate until the edges stay as they are. A round is two aggregations with
    map-side minima and joins that AQE may split, and ends in a checkpoint, so that neither lineage nor
    a lost executor costs more than one round. Nulls and loops are ignored; repeated edges count once;
    without edges the result is empty.
    """
    ship_package(edges.sparkSession)
    schema = "u bigint, v bigint"
    now = cut(edges.where("a <> b").select("a", "b").mapInArrow(tidied(_contracted), schema))
    now = cut(now.coalesce(now.count() // TASK_EDGES + 1).mapInArrow(tidied(_contracted), schema))
    before = _mark(now)
    for _ in range(MAX_ROUNDS if before["n"] else 0):
        now = cut(_small_star(_large_star(now)))
        mark = _mark(now)
        if mark == before:
            break
        before = mark
    else:
        if before["n"]:
            raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _large_star(edges: DataFrame) -> DataFrame:
    """Joins each larger neighbour of a node to the least of the node and its neighbours (repeats stay until the next step)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Joins each smaller neighbour of a node, and the node, to the least of these neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
