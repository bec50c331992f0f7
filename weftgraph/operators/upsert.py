"""MERGE-style upserts as folds over ordered change logs.

A batch of writes is a DataFrame with a `seq` column, the order in which its
writes apply. What is stored already takes part before all of them. One grouping
by key, with map-side partial aggregation, gives the new state; a key with very
many writes is reduced before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph import schema as X

def merge_node(existing: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Get or create by key: the keys of both, once each."""
    return existing.select(*keys).unionByName(batch.select(*keys)).distinct()


def upsert(existing: DataFrame | None, batch: DataFrame, keys: Sequence[str], first: Sequence[str] = (), last: Sequence[str] = (), seq: str | Sequence[str] = "seq") -> DataFrame:
    """The state after a batch: `first` columns keep the first write's values, `last` columns take the last one's.

    `seq` names the column or columns whose values order the writes of a key. Values of
    one write stay together; a null that a deciding write set is kept.
    """
    columns = [*keys, *first, *last]
    order = F.struct(F.lit(1).alias("t"), *(F.col(c) for c in ([seq] if isinstance(seq, str) else seq)))
    log = batch.select(*columns, order.alias("_at"))
    if existing is not None:
        # What is stored comes before any write.
        none = F.struct(F.lit(0).alias("t"), *(F.lit(None).cast(f.dataType).alias(f.name) for f in log.schema["_at"].dataType.fields[1:]))
        log = existing.select(*columns, none.alias("_at")).unionByName(log)
    parts = []
    if first:
        parts.append(F.min_by(F.struct(*first), "_at").alias("_first"))
    if last:
        parts.append(F.max_by(F.struct(*last), "_at").alias("_last"))
    if not parts:
        return log.select(*keys).distinct()
    return log.groupBy(*keys).agg(*parts).select(*keys, *(F.col(f"_first.{c}").alias(c) for c in first), *(F.col(f"_last.{c}").alias(c) for c in last))


def upsert_label(label: str, existing: DataFrame | None, batch: DataFrame, seq: str = "seq") -> DataFrame:
    """`upsert` with the keys and write rules of a node label."""
    keys, first = X.KEYS[label], X.FIRST_WRITE.get(label, [])
    return upsert(existing, batch, keys, first, [c for c in X.NODES[label].fieldNames() if c not in keys and c not in first], seq)


def merge_edges(existing: DataFrame | None, batch: DataFrame) -> DataFrame:
    """At most one edge for each source, type and destination."""
    columns = ["src", "type", "dst"]
    rows = batch.select(*columns)
    return (rows if existing is None else existing.select(*columns).unionByName(rows)).distinct()


def temporal_edges(log: DataFrame, keys: Sequence[str] = ("src", "dst"), existing: DataFrame | None = None, seq: Sequence[str] = ("seq",)) -> DataFrame:
    """Folds a log of additions and removals into edges with a soft-deletion state.

    log: keys, op (add or remove), sha and the columns of `seq`, which order all
    writes of an edge. An edge exists from its first addition on; `added_in_commit`
    is that one's; it is active if the last write from there on is an addition;
    `deleted_in_commit` is the last removal's and stays if the edge is added again.
    """
    order = F.struct(F.lit(1).alias("t"), *(F.col(c) for c in seq))
    rows = log.select(*keys, "op", "sha", F.lit(None).cast("string").alias("gone"), F.lit(True).alias("on"), order.alias("at"))
    if existing is not None:
        typed = rows.schema["at"].dataType
        stored = F.struct(F.lit(0).alias("t"), *(F.lit(None).cast(f.dataType).alias(f.name) for f in typed.fields[1:]))
        rows = rows.unionByName(existing.select(*keys, F.lit("add").alias("op"), F.col("added_in_commit").alias("sha"), F.col("deleted_in_commit").alias("gone"), F.col("is_active").alias("on"), stored.alias("at")))
    add, remove = F.col("op") == "add", F.col("op") == "remove"
    folded = rows.groupBy(*keys).agg(
        F.min(F.when(add, F.col("at"))).alias("first_add"),
        F.min_by("sha", F.when(add, F.col("at"))).alias("added_in_commit"),
        F.max(F.when(remove, F.col("at"))).alias("last_remove"),
        F.max_by("sha", F.when(remove, F.col("at"))).alias("removed_by"),
        F.max_by(F.when(add, F.col("on")).otherwise(False), "at").alias("is_active"),
        F.max(F.when(F.col("at.t") == 0, F.col("gone"))).alias("gone"),
    )
    later = F.col("last_remove") > F.col("first_add")
    return folded.where("first_add IS NOT NULL").select(
        *keys, "added_in_commit", F.when(later, F.col("removed_by")).otherwise(F.col("gone")).alias("deleted_in_commit"), F.col("is_active"),
    )


def conditional_edges(children: DataFrame, parents: DataFrame, child_key: Sequence[str], parent_key: Sequence[str]) -> DataFrame:
    """The children whose parent exists: an inner join on the parent's key, which is unique."""
    on = [children[a] == parents[b] for a, b in zip(child_key, parent_key, strict=True)]
    return children.join(parents.select(*parent_key).distinct(), on, "left_semi")


def detach_delete(nodes: DataFrame, edges: DataFrame, doomed: Column, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Nodes without the doomed ones, and edges without those that touch one."""
    gone = nodes.where(doomed).select(F.col(key).alias("_gone"))
    kept = nodes.where(~F.coalesce(doomed, F.lit(False)))
    left = edges.join(gone, F.col("src") == F.col("_gone"), "left_anti")
    return kept, left.join(gone, F.col("dst") == F.col("_gone"), "left_anti")


def mutation_counts(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: how many keys a write created and deleted."""
    both = before.select(*keys).distinct().withColumn("b", F.lit(1)).join(after.select(*keys).distinct().withColumn("a", F.lit(1)), list(keys), "full")
    return both.agg(F.count_if(F.col("b").isNull()).alias("created"), F.count_if(F.col("a").isNull()).alias("deleted"))


def without_known(listed: DataFrame, known: DataFrame, key: str, force: bool = False) -> DataFrame:
    """Listed rows whose key isn't known yet (all of them with `force`); nulls in the known keys don't matter."""
    return listed if force else listed.join(known.select(key).distinct(), key, "left_anti")
