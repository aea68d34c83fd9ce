"""Connected components of an edge table: edges contracted inside tasks, roots hooked on smaller neighbours, all on Spark."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from slicewatch.llm.common import cut_lineage, ship_package

#: Edges that a task contracts at a time.
BUFFER = 1 << 20


def components(edges: DataFrame, a: str = "a", b: str = "b", start: DataFrame | None = None) -> DataFrame:
    """``(node, label)`` for every node of ``edges`` (two columns of whole numbers); label = the smallest node id
    it can reach. ``start``: the result over earlier edges, written; these edges are added to those (each joins
    two different nodes).

    First every task replaces its edges by stars, each node to the smallest it reaches over them; what the
    tasks know together is left to the rounds. Each round hooks every root on its smallest neighbour if that
    is smaller (a partial minimum, so a hub ships one row per task), follows the hooks to their tops by pointer
    jumping, and contracts the edges to edges between tops, until none is left. A root that neither hooks nor
    takes in all its neighbours has a neighbour that went lower, so it hooks in the next round: two rounds at
    least halve the roots of a component, whatever its shape. Tables are written per step, and whether a
    further one is needed is counted while writing: every query and exchange leaves plans, threads and compiled
    code in the driver. Joins are plain equi-joins, so hubs are split by AQE.
    """
    ship_package(edges.sparkSession)
    edges = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
    if start is not None:
        edges = _lifted(edges, start.select(F.col("node").alias("root"), F.col("label").alias("top")))
    live, labels = cut_lineage(_contracted(edges), "edges"), start
    while True:
        tops = _tops(live)
        if labels is None:  # the first round's roots are all nodes
            labels = tops.select(F.col("root").alias("node"), F.col("top").alias("label"))
        else:  # roots that are no label are nodes which ``start`` did not have
            labels = cut_lineage(labels.join(tops, labels["label"] == tops["root"], "full")
                                 .select(F.coalesce("node", "root").alias("node"), F.coalesce("top", "label").alias("label")), "labels")
        left = Observation()
        live = cut_lineage(_contracted(_lifted(live, tops).observe(left, F.count(F.lit(1)).alias("n"))), "edges")
        if not left.get["n"]:
            return labels


def _lifted(edges: DataFrame, tops: DataFrame) -> DataFrame:
    """The edges between the tops of their ends; an end without one stays."""
    u, v = F.coalesce("tu", "u"), F.coalesce("tv", "v")
    return (edges.join(tops.select(F.col("root").alias("u"), F.col("top").alias("tu")), "u", "left")
            .join(tops.select(F.col("root").alias("v"), F.col("top").alias("tv")), "v", "left")
            .filter(u != v).select(u.alias("u"), v.alias("v")))


def _tops(live: DataFrame) -> DataFrame:
    """``(root, top)``: where the hooks from each root end. Hooks lead to smaller ids, so jumping ends."""
    tops = cut_lineage(live.groupBy(F.col("u").alias("root")).agg(F.min("v").alias("top")), "hooks")
    while True:
        up = tops.select(F.col("root").alias("top"), F.col("top").alias("up"))
        jumped = Observation()
        tops = cut_lineage(tops.join(up, "top").observe(jumped, F.count(F.when(F.col("up") != F.col("top"), 1)).alias("n"))
                           .select("root", F.col("up").alias("top")), "hooks")
        if not jumped.get["n"]:
            return tops


def _contracted(edges: DataFrame) -> DataFrame:
    """Stars (u, v) with u >= v in place of the edges of a task, the centre with itself: the same components and nodes."""
    return edges.mapInArrow(_stars, "u long, v long")


def _stars(batches):
    def flush():
        nodes, root = star_centres(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(root)], names=["u", "v"])
    held, size = [], 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        size += batch.num_rows
        if size >= BUFFER:
            yield flush()
            held, size = [], 0
    if size:
        yield flush()


def star_centres(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node it reaches over these edges) of every node, by hooking and pointer jumping."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y = at[:len(u)], at[len(u):]
    root = np.arange(len(nodes))
    while len(x):
        np.minimum.at(root, x, y)
        np.minimum.at(root, y, x)
        while (root[root] != root).any():
            root = root[root]
        x, y = root[x], root[y]
        x, y = x[x != y], y[x != y]
    return nodes, nodes[root]
