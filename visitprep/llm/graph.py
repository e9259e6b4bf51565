"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Edges that one local contraction holds at a time.
LOCAL_EDGES = 1_000_000


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of an edge list and the smallest node that each one reaches."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while True:  # pointers to their ends
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def contracted(edges: DataFrame) -> DataFrame:
    """Each task's edges (a, b) as stars around its local roots: fewer edges, the same components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def star() -> pa.RecordBatch:
            a, b = (np.concatenate([x.column(i).to_numpy(zero_copy_only=False) for x in held]) for i in (0, 1))
            nodes, root = roots(a, b)
            keep = nodes != root
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(root[keep])], names=["a", "b"])

        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= LOCAL_EDGES:
                yield star()
        if sum(map(len, held)):
            yield star()

    return edges.select("a", "b").mapInArrow(common.trimmed_task(run), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edge list (a, b), with the smallest node as root.

    Local contraction, then alternating large-star and small-star rounds.  Each round's result is a
    table in the shared folder, so both sides of every join are plain shuffles that adaptive
    execution can split when one node has a large share of the edges.
    """
    edges = common.written(contracted(edges.filter("a <> b")), "edges")
    while True:
        both = edges.union(edges.select("b", "a"))
        lowest = common.written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")), "low")
        # Large star: larger neighbours move to the smallest one.
        large = both.join(lowest, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct()
        large = common.written(large, "large")
        # Small star: a node and its smaller neighbours move to the smallest of them.
        low = common.written(large.groupBy("a").agg(F.min("b").alias("low"), F.count(F.lit(1)).alias("n")), "low")
        more = large.join(low.filter("n > 1"), "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        after = common.written(low.select("a", F.col("low").alias("b")).union(more).distinct(), "edges")
        # Stars only: no node is both a leaf and a root, and no leaf has two roots.
        done = low.filter("n > 1").isEmpty() and after.join(after.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()
        common.discard(edges, lowest, large, low)
        edges = after
        if done:
            break
    return after.select(F.col("a").alias("node"), F.col("b").alias("root")).union(after.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
