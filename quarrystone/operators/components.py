"""Connected components by alternating large-star and small-star steps.

Each step is one aggregation and one join over the edge table, so no node's
neighbourhood has to fit in a task; after O(log n) rounds the edges are stars
around each component's least node.  Every round is written to the shared folder
and reread, which cuts the lineage and survives the loss of executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.session import discard, materialize, ship

#: Edges that ``forest`` holds at once.
FOREST_EDGES = 2_000_000


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node of its component, for every node of an edge.

    Nulls and self loops are dropped, repeated and reversed edges count once; with
    no edges the result is empty.  A node without edges doesn't occur.
    """
    x, y = F.col(a), F.col(b)
    now = edges.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).where(x.isNotNull() & y.isNotNull() & (F.col("u") > F.col("v"))).distinct()
    spark = edges.sparkSession
    now, path = materialize(now, "components")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        large, mid = materialize(large, "components")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        new, new_path = materialize(small, "components")
        discard(spark, mid)
        discard(spark, path)
        before, now, path = mark, new, new_path
        mark = _mark(now)
        if mark == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """Number and order-free checksum of the edges: equal marks mean that a round changed nothing."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())


def forest(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(a, b): stars that join the same nodes as ``edges``, for whole numbers as nodes.

    Each task joins the nodes of up to ``FOREST_EDGES`` edges at a time and leaves one edge a node, so edges that
    stand near one another shrink to their nodes before ``components`` shuffles them.  Nulls are dropped.
    """
    ship(edges.sparkSession)
    held = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a is not null and b is not null")
    return held.mapInArrow(_stars, "a long, b long")


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        n += batch.num_rows
        if n >= FOREST_EDGES:
            yield _star(held)
            held, n = [], 0
    if held:
        yield _star(held)


def _star(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = (np.concatenate(x) for x in zip(*held, strict=True))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    least = np.arange(len(nodes))
    while True:
        p, q = least[x], least[y]
        apart = p != q
        if not apart.any():
            break
        # only edges between different trees remain; each greater root hangs itself on a lesser one
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(least, np.maximum(p, q), np.minimum(p, q))
        while not np.array_equal(up := least[least], least):
            least = up
    keep = least != np.arange(len(nodes))
    return pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(nodes[least[keep]])], ["a", "b"])
