"""Incremental ingest: each micro-batch of writes is folded onto a stored snapshot.

A table is kept in buckets by its key's hash. Batch n writes a version of the buckets
that its rows touch, from the newest version before it; the others stay as they are.
Versions are named by their batch, so a batch that runs again after a failure writes
the same ones again and changes nothing twice. Of each bucket the two newest versions
are kept: the current one, and the one that it was made from.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftgraph.operators import upsert
from weftgraph.plans.materialize import delete
from weftgraph.sources.readers import exists


BUCKETS = 32


class Versions:
    """A table kept as numbered versions of its buckets below a path."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str] = ()) -> None:
        self.spark, self.path, self.keys = spark, path, keys

    def _names(self, path: str) -> list[str]:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return [f.getPath().getName() for f in target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(target)]

    def _finished(self) -> list[int]:
        """Finished versions, the newest first."""
        if not exists(self.spark, self.path):
            return []
        return sorted((int(n[1:]) for n in self._names(self.path) if n.startswith("v") and exists(self.spark, f"{self.path}/{n}/_SUCCESS")), reverse=True)

    def _of_buckets(self, below: int) -> dict[int, list[str]]:
        """Paths of each bucket's versions that batches before `below` wrote, the newest first."""
        out: dict[int, list[str]] = {}
        for n in self._finished():
            if n < below:
                for name in self._names(f"{self.path}/v{n}"):
                    if name.startswith("bucket="):
                        out.setdefault(int(name[7:]), []).append(f"{self.path}/v{n}/{name}")
        return out

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(BUCKETS)).cast("int")

    def before(self, batch: int, buckets: Sequence[int] | None = None) -> DataFrame | None:
        """The newest rows that earlier batches wrote, of all buckets or of some."""
        paths = [p[0] for b, p in sorted(self._of_buckets(batch).items()) if buckets is None or b in buckets]
        return self.spark.read.parquet(*paths) if paths else None

    def write(self, batch: int, rows: DataFrame) -> None:
        rows.withColumn("bucket", self.bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/v{batch}")
        for paths in self._of_buckets(batch + 1).values():
            for old in paths[2:]:
                delete(self.spark, old)

    def latest(self) -> DataFrame | None:
        return self.before(2**62)


def _each_batch(rows: DataFrame, versions: Versions, checkpoint: str, fold: Callable[[DataFrame, DataFrame | None], DataFrame]) -> StreamingQuery:
    """Runs until all that is there is read: `fold` makes the new rows of a batch's buckets from the batch and the stored ones."""

    def run(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            touched = [r["b"] for r in batch.select(versions.bucket().alias("b")).distinct().collect()]  # BUCKETS numbers at most
            versions.write(number, fold(batch, versions.before(number, touched)))
        finally:
            batch.unpersist()

    return rows.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_upsert(writes: DataFrame, path: str, checkpoint: str, keys: Sequence[str], first: Sequence[str] = (), last: Sequence[str] = (), seq: str = "seq") -> StreamingQuery:
    """Folds a stream of writes (with an order column) onto versions below `path`; runs until all that is there is read.

    `seq` is kept with the values, so that writes that arrive late don't undo later ones.
    """

    def fold(batch: DataFrame, stored: DataFrame | None) -> DataFrame:
        log = batch.select(*keys, F.col(seq).cast("bigint").alias("seq"), *first, *last)
        new = log.groupBy(*keys).agg(
            F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"),
            *(F.min_by(c, "seq").alias(c) for c in first), *(F.max_by(c, "seq").alias(c) for c in last),
        )
        if stored is None:
            return new
        return stored.unionByName(new).groupBy(*keys).agg(
            F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq"),
            *(F.min_by(c, "first_seq").alias(c) for c in first), *(F.max_by(c, "last_seq").alias(c) for c in last),
        )

    return _each_batch(writes, Versions(writes.sparkSession, path, keys), checkpoint, fold)


def stream_new(rows: DataFrame, path: str, checkpoint: str, key: str) -> StreamingQuery:
    """Keeps the first row of each key that no version has yet."""

    def add(batch: DataFrame, stored: DataFrame | None) -> DataFrame:
        fresh = batch.dropDuplicates([key])
        return fresh if stored is None else stored.unionByName(upsert.without_known(fresh, stored, key))

    return _each_batch(rows, Versions(rows.sparkSession, path, [key]), checkpoint, add)


def windowed_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums per window and kind of a stream, with a watermark for late rows."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    counted = timed.groupBy(F.window(time, size), kind).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("window.start").alias("start"), kind, "n", "total")


def run_to_end(make: Callable[[], StreamingQuery]) -> None:
    """Starts a query that reads what is there and waits for its end."""
    query = make()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
