"""Connected components of an edge table.

At most `ONE_TASK_EDGES` edges, counted first, are contracted by one task in
arrays of some tens of MB. Beyond that, alternating star contraction does it:
each round lets every node point its neighbours to the least node it knows, once
for the larger and once for the smaller neighbours, until nothing changes; the
number of rounds grows with the logarithm of the longest path. A node's least
neighbour is found by a partial aggregate and joined back, so the rows of a hub
are split like those of any skewed join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.plans.materialize import Scratch

ONE_TASK_EDGES = 1_000_000


def contract(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (u, v), and the least node of each one's component."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while len(a):
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return nodes, nodes[label]


def _contract_all(batches):
    edges = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if edges:
        nodes, least = contract(*(np.concatenate(side) for side in zip(*edges, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(least)], ["id", "component"])


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")).first()
    return row["n"], row["x"]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(scratch: Scratch, pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component) of every node in an edge between two nodes; the component is its least node. Ids are long."""
    given = pairs.where(F.col(a) != F.col(b)).select(F.col(a).alias("u"), F.col(b).alias("v"))
    if given.count() <= ONE_TASK_EDGES:
        return scratch.put(given.coalesce(1).mapInArrow(_contract_all, "id bigint, component bigint"), "components")
    return stars(scratch, given)


def stars(scratch: Scratch, given: DataFrame) -> DataFrame:
    """The same for edges (u, v) of any number."""
    edges = scratch.put(given.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(edges)
    while state[0]:
        large = scratch.put(_large_star(edges), "large")
        small = scratch.put(_small_star(large), "small")
        scratch.drop(edges, large)
        edges = small
        if state == (state := _state(edges)):
            break
    # A fixed point is a star: each node points at its component's least node.
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
