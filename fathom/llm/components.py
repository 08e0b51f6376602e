"""Connected components of an edge table: forests by task, then alternating large-star and small-star steps.

Rows are (a, b) pairs of longs. Each task first joins the edges it reads and
sends each of its nodes once, with the smallest one that it knows to be
reachable. While more than ``TASK_EDGES`` of these are left, they go through
star steps, of which each is a shuffle on a node and a written table, so
lineage stays short and nothing is gathered on the driver; no more than that
bounded number are joined by one task, in one step and without a shuffle. A
node of high degree is pre-aggregated to its minimum before its edges are
read, and edges are distinct.

Defined cases: no edges, or only loops, give no rows; edges with a null end
are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, settle
from .textkit import tidy

#: Edges that a task joins at once, 16 bytes each.
TASK_EDGES = 1 << 20


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the smallest node that each reaches), nodes ascending."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    top = np.arange(len(nodes))
    while len(x):
        low, high = np.minimum(x, y), np.maximum(x, y)
        np.minimum.at(top, high, low)
        while (top[top] != top).any():
            top = top[top]
        x, y = top[x], top[y]
        live = x != y
        x, y = x[live], y[live]
    return nodes, nodes[top]


def _forest(edges: DataFrame) -> DataFrame:
    """(a, b), b < a: what each task's edges join, a node's edge to the smallest one of each part."""

    @tidy
    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(np.stack([batch.column(k).to_numpy() for k in range(2)]))
            size += batch.num_rows
            if size >= 2 * TASK_EDGES:
                held = [_stars(held)]
                size = held[0].shape[1]
                if size >= TASK_EDGES:
                    yield _batch(held[0])
                    held, size = [], 0
        if held:
            yield _batch(_stars(held))

    return edges.mapInArrow(run, "a long, b long")


def _joined(edges: DataFrame) -> DataFrame:
    """(node, component) of at most TASK_EDGES settled edges, which one task reads."""

    @tidy
    def run(batches):
        held = [np.stack([batch.column(k).to_numpy() for k in range(2)]) for batch in batches]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in least_reachable(*np.concatenate(held, axis=1))], names=["node", "component"])

    return edges.coalesce(1).mapInArrow(run, "node long, component long")


def _stars(held: list[np.ndarray]) -> np.ndarray:
    a, b = least_reachable(*np.concatenate(held, axis=1))
    return np.stack([a, b])[:, a != b]


def _batch(edges: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(edges[0]), pa.array(edges[1])], names=["a", "b"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select("a", "b")
    if large:
        both = both.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = both.join(least, "a")
    if large:
        return joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
    moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(joined.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether each node but the roots has one edge, and that to a root."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("in").alias("in")).filter("out > 1 or (out = 1 and `in` = 1)").isEmpty()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): component is the smallest node reachable; only nodes that have an edge to another."""
    a, b = F.col("a").cast("long"), F.col("b").cast("long")
    now = settle(_forest(edges.select(a.alias("a"), b.alias("b")).filter("a <> b")), "edges")
    for _ in range(most_rounds):
        if now.count() <= TASK_EDGES:
            return _joined(now)
        if _settled(now):
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        after = settle(_star(_star(now, True), False), "edges")
        discard(now)
        now = after
    raise RuntimeError(f"components: no fixpoint after {most_rounds} rounds")
