"""Connected components of a graph given as edges, without bringing nodes or edges to the driver.

First each task ties the nodes that its own edges connect to the least of them.  Then large-star and small-star steps in
turn (Kiveris et al., 2014): each node's neighbours are tied to the least of them, until nothing changes.  A node with many neighbours is aggregated before the shuffle, and its edges meet its least neighbour in
a join that adaptive execution can split.  Each round is written to the shared folder, so lineage stays short.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanework.llm.store import removed, stored_and_told

ROUNDS = 60
#: Edges that a task looks at together.
EDGES = 1 << 20


def least_nodes(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of these edges, ascending, and the least node that each is connected with."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    root = np.arange(len(nodes))
    while True:
        least, new = np.minimum(root[a], root[b]), root.copy()
        for at in (a, b, root[a], root[b]):
            np.minimum.at(new, at, least)
        new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def _tied_in_tasks(edges: DataFrame) -> DataFrame:
    def run(batches):
        held: list[pa.RecordBatch] = []

        def flush():
            u, v = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("u", "v"))
            held.clear()
            nodes, root = least_nodes(u, v)
            own = nodes != root
            yield from pa.table({"u": nodes[own], "v": root[own]}).to_batches(100_000)

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= EDGES:
                yield from flush()
        if held:
            yield from flush()

    return edges.select("u", "v").mapInArrow(run, "u long, v long")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = edges.join(least, "u")
    return tied.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root): for each node of an edge (u, v), bigint, the least node of its component."""
    sums = {"n": F.count(F.lit(1)), "s": F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))}
    begun = _tied_in_tasks(edges.where("u <> v")).distinct()
    now, path, state = stored_and_told(begun, f"{name}-0", **sums)
    for i in range(1, ROUNDS):
        if not state["n"]:
            break
        before, old = state, path
        now, path, state = stored_and_told(_small_star(_large_star(now)), f"{name}-{i}", **sums)
        removed(edges.sparkSession, old)  # the next round is whole: nothing reads the last one
        if state == before:
            break
    else:
        raise RuntimeError(f"components aren't settled after {ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
