"""Connected components by alternating large-star and small-star rounds over written tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch


def spanning_roots(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of an edge list and the smallest node of each one's component (one task's own edges)."""
    nodes, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = at[: len(left)], at[len(left) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if np.array_equal(root, before):
            return nodes, nodes[root]


def components(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    """``id, root``: every node of the long columns ``a, b`` once, with the smallest node it is linked to.

    Tasks first span what they hold of the edges. Each round then hooks a node's larger neighbours (then its smaller
    ones) to the least of them, until every node is hooked once, to a node that is not hooked itself. Edges are
    written after each round, so a lost executor costs one round.
    """

    def span(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches if b.num_rows]
        if held:
            nodes, roots = spanning_roots(*map(np.concatenate, zip(*held, strict=True)))
            hooked = nodes != roots
            yield pa.RecordBatch.from_arrays([pa.array(nodes[hooked], pa.int64()), pa.array(roots[hooked], pa.int64())], ["a", "b"])

    now = scratch.write(edges.select("a", "b").where("a != b").mapInArrow(span, "a long, b long").distinct(), f"{name}0")
    step, written = 0, f"{name}0"
    while True:
        twice = now.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a")
        hooked_on = now.select(F.col("b").alias("a")).join(now.select("a"), "a", "left_semi")
        if twice.union(hooked_on).isEmpty():
            return now.select(F.col("a").alias("id"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
        both = now.union(now.select(F.col("b"), F.col("a"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a != b").distinct()
        step += 1
        now = scratch.write(small, f"{name}{step}")
        scratch.drop(written)
        written = f"{name}{step}"
