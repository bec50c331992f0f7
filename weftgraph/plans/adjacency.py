"""Stored adjacency: nodes, and edges in both directions, bucketed and sorted by their keys.

All three tables have the same number of buckets, so a join of edges with the nodes at
their near end, or of edges with edges end to end, needs no shuffle, and the edges of a few
named nodes are read from the buckets of those alone. They are tables of the session's
catalogue over files in the shared folder.

Where nodes have numbers (`of_numbers`), edges are dealt and stored by these, and only the
edges that a question reads get the ids of their ends. A question that names few nodes of tables of numbers
needs no stored edges: `Edges` and `Changes` make those of the named nodes from the tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators.segments import STORED
from weftgraph.plans.materialize import Scratch

#: Buckets of a table unless it says otherwise: for large graphs, as many as keep a bucket within an executor's memory.
BUCKETS = 8
#: Order lines of the change graph whose edges make a bucket.
BUCKET_LINES = 1_000_000


@dataclass
class Adjacency:
    """nodes by id; out: edges by src; into: edges by dst."""

    nodes: DataFrame
    out: DataFrame
    into: DataFrame
    numbered: bool = False

    @classmethod
    def of_numbers(cls, nodes: DataFrame, edges: Sequence[DataFrame], buckets: int = BUCKETS) -> Adjacency:
        """nodes: nr, id and properties; edges: parts of src and dst, which are numbers, and equal properties.

        Parts that are dealt by src into as many partitions as there are buckets are not moved again for `out`.
        """
        spark, home = nodes.sparkSession, Scratch(nodes.sparkSession, "adjacency").home

        def table(parts: Sequence[DataFrame], key: str, name: str) -> DataFrame:
            known = f"weft_{name}_{uuid.uuid4().hex}"
            for rows in parts:
                rows.write.mode("append").bucketBy(buckets, key).sortBy(key).option("path", f"{home}/{name}").options(**STORED).format("parquet").saveAsTable(known)
            return spark.table(known)

        out = table(edges, "src", "out")
        return cls(table([nodes.repartition(buckets, "nr")], "nr", "nodes"), out, table([out.repartition(buckets, "dst")], "dst", "into"), True)

    @classmethod
    def build(cls, nodes: DataFrame, edges: DataFrame, buckets: int = BUCKETS) -> Adjacency:
        """nodes: id and properties; edges: src, type, dst and properties."""
        spark, home = nodes.sparkSession, Scratch(nodes.sparkSession, "adjacency").home

        def table(rows: DataFrame, key: str, name: str) -> DataFrame:
            known = f"weft_{name}_{uuid.uuid4().hex}"
            # One file for each bucket.
            dealt = rows.repartition(buckets, key)
            dealt.write.bucketBy(buckets, key).sortBy(key).option("path", f"{home}/{name}").option("compression", "zstd").format("parquet").saveAsTable(known)
            return spark.table(known)

        out = table(edges, "src", "out")  # the other direction is dealt from this, so that edges are made once
        return cls(table(nodes, "id", "nodes"), out, table(out, "dst", "into"))

    def edges_of(self, ids: Sequence[str], out: bool) -> DataFrame:
        """The edges that leave (out) or reach some nodes, from their buckets alone."""
        if self.numbered:
            near, far = ("src", "dst") if out else ("dst", "src")
            own = self.nodes.where(F.col("id").isin(list(ids))).select("nr", "id").distinct().collect()  # of the nodes named
            named = self.nodes.sparkSession.createDataFrame(own, "nr bigint, id string")
            edges = (self.out if out else self.into).where(F.col(near).isin([r["nr"] for r in own]))
            edges = edges.join(F.broadcast(named.withColumnsRenamed({"nr": near, "id": "_near"})), near).join(self.nodes.select(F.col("nr").alias(far), F.col("id").alias("_far")).distinct(), far)
            return edges.withColumns({near: F.col("_near"), far: F.col("_far")}).drop("_near", "_far")
        return (self.out if out else self.into).where(F.col("src" if out else "dst").isin(list(ids)))

    def hop(self, types: Sequence[str], out: bool = True) -> DataFrame:
        """Each node with its edges of some types: the node's properties, type and `other`, the node at the far end (its number, where nodes have numbers). No shuffle."""
        near, far = ("src", "dst") if out else ("dst", "src")
        if self.numbered:
            edges = (self.out if out else self.into).where(F.col("type").isin(*types)).select(F.col(near).alias("nr"), "type", F.col(far).alias("other"))
            return self.nodes.join(edges.hint("merge"), "nr").drop("nr")
        edges = (self.out if out else self.into).where(F.col("type").isin(*types)).select(F.col(near).alias("id"), "type", F.col(far).alias("other"))
        return self.nodes.join(edges.hint("merge"), "id")


@dataclass
class Edges:
    """Edges that are made where a question names their nodes, so that none are stored.

    nodes: nr and id; near: the edges (src, type, dst and properties, by number) that leave (True) or reach some numbers.
    Edges whose far end is no node are left out.
    """

    nodes: DataFrame
    near: Callable[[Sequence[int], bool], DataFrame]

    def edges_of(self, ids: Sequence[str], out: bool) -> DataFrame:
        """The edges that leave (out) or reach some nodes."""
        spark, (near, far) = self.nodes.sparkSession, ("src", "dst") if out else ("dst", "src")
        own = self.nodes.where(F.col("id").isin(list(ids))).select("nr", "id").distinct().collect()  # of the nodes named
        named = spark.createDataFrame(own, "nr bigint, id string")
        # Written, as Spark then knows that they are few, and doesn't move nodes to them.
        edges = Scratch(spark, "near").put(self.near([r["nr"] for r in own], out), "edges")
        edges = edges.join(F.broadcast(named.withColumnsRenamed({"nr": near, "id": "_near"})), near).join(self.nodes.select(F.col("nr").alias(far), F.col("id").alias("_far")), far)
        return edges.withColumns({near: F.col("_near"), far: F.col("_far")}).drop("_near", "_far").distinct()


@dataclass
class Changes:
    """Changes that get the shas of their commits and the ids of their nodes where a question names either.

    nodes: nr and id; lines: commit and nr, by number, which may repeat; sha: that of a commit's number.
    Rows are src (sha) and dst (id). What is found is written at each step, so that Spark broadcasts it where it is little.
    """

    nodes: DataFrame
    lines: DataFrame
    sha: Callable[[Column], Column]

    def of_commits(self, commits: DataFrame) -> DataFrame:
        """The changes of some commits. commits: sha."""
        scratch = Scratch(self.nodes.sparkSession, "changes")
        asked = scratch.put(commits.select("sha").distinct(), "shas")
        lines = self.lines.where("commit IS NOT NULL").withColumn("sha", self.sha(F.col("commit"))).join(asked, "sha").select(F.col("sha").alias("src"), "nr").distinct()
        return scratch.put(lines, "lines").join(self.nodes, "nr").select("src", F.col("id").alias("dst")).distinct()

    def of_nodes(self, ids: DataFrame) -> DataFrame:
        """The changes of some nodes. ids: id."""
        scratch = Scratch(self.nodes.sparkSession, "changes")
        asked = scratch.put(self.nodes.join(ids.select("id").distinct(), "id").select("nr", F.col("id").alias("dst")).distinct(), "nodes")
        return self.lines.join(asked, "nr").select("commit", "dst").distinct().select(self.sha(F.col("commit")).alias("src"), "dst")
