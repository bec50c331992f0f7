"""Temporal edges as keyed state over a stream of dependency writes.

The state of an edge, in the state store, is all that the fold of its log needs: its
first addition, its last addition and its last removal, each by the order column. They
can be brought up to date by writes in any order, so a late write gives what it would
have given in time, and a repeated one changes nothing. A micro-batch emits the edges
that it changed, numbered by the edge's own changes; `changes` writes them by batch, and
a batch that runs again writes the same ones again; `current` takes the last of each edge.

The stream needs a state store with column families:
spark.sql.streaming.stateStore.providerClass =
org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider

Cases: writes with a null source, destination, operation or order are left out; a removal
before an edge's first addition makes no edge; writes of one edge that are equal in order
must be equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

STATE = "first_add bigint, added_by string, last_add bigint, last_remove bigint, removed_by string, version bigint"
EDGE = "src string, dst string, added_in_commit string, deleted_in_commit string, is_active boolean, version bigint"


def folded(state: tuple | None, writes: Iterator[tuple[int, str, str]]) -> tuple:
    """The state after writes (order, operation, commit), in whatever order they come. Its version is not touched."""
    first, added_by, last, removed, removed_by, version = state or (None, None, None, None, None, 0)
    for seq, op, sha in writes:
        if op == "add":
            if first is None or seq < first:
                first, added_by = seq, sha
            last = seq if last is None else max(last, seq)
        elif op == "remove" and (removed is None or seq > removed):
            removed, removed_by = seq, sha
    return first, added_by, last, removed, removed_by, version


def edge_of(state: tuple) -> tuple | None:
    """(added_in_commit, deleted_in_commit, is_active); None where there is no edge yet."""
    first, added_by, last, removed, removed_by, _ = state
    if first is None:
        return None
    later = removed is not None and removed > first
    return added_by, removed_by if later else None, not later or last > removed


class EdgeState(StatefulProcessor):
    """Folds the writes of one edge onto its state and emits the edge if it changed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.edge = handle.getValueState("edge", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = tuple(self.edge.get()) if self.edge.exists() else None
        new = folded(old, (w for pdf in rows for w in zip(pdf["seq"].tolist(), pdf["op"], pdf["sha"], strict=True)))
        before, after = edge_of(old) if old else None, edge_of(new)
        if after != before:
            new = (*new[:5], new[5] + 1)
        if new != old:
            self.edge.update(new)
        if after != before:
            yield pd.DataFrame([(*key, *after, new[5])], columns=[c.split()[0] for c in EDGE.split(", ")])

    def close(self) -> None:
        pass


def edge_changes(writes: DataFrame) -> DataFrame:
    """The stream of changed edges of a stream of writes: src, dst, op (add or remove), sha, seq (a long)."""
    rows = writes.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), "op", "sha", F.col("seq").cast("bigint").alias("seq")).dropna(subset=["src", "dst", "op", "seq"])
    return rows.groupBy("src", "dst").transformWithStateInPandas(statefulProcessor=EdgeState(), outputStructType=EDGE, outputMode="Update", timeMode="None")


def changes(writes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes the changed edges of each micro-batch below `path`; runs until all that is there is read."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return edge_changes(writes).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str) -> DataFrame:
    """The edges as they are after all batches below `path`."""
    rows = spark.read.schema(EDGE).parquet(path)
    last = F.row_number().over(Window.partitionBy("src", "dst").orderBy(F.desc("version")))
    return rows.withColumn("_n", last).where("_n = 1").drop("_n", "version", "batch")
