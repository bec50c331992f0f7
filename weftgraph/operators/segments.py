"""Segments of an index: folders of Parquet tables that are never written again.

A batch of new or changed rows makes a segment of its own, in any folder; the keys of
rows that it replaces or removes stand in its table `gone` and hide those rows in the
segments before it. Readers take all segments together. Folding them into one is the
index's own affair, as it knows its tables.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Segments after which an index should be folded into one.
MOST_SEGMENTS = 8
#: How Parquet stores an index: ascending numbers, of which it has many, as their differences.
STORED = {"compression": "zstd", "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary#at.list.element": "false"}


@dataclass
class Segments:
    """Folders of segments, oldest first, and which of them hide rows of older ones. `key` is the key's type."""

    spark: SparkSession
    key: str
    folders: list[str] = field(default_factory=list)
    hiding: list[bool] = field(default_factory=list)

    def write(self, folder: str, tables: dict[str, tuple[DataFrame, Sequence[str]]], gone: DataFrame | None = None) -> None:
        """A new segment: each table with the columns that name its folders; gone: key."""
        for name, (rows, by) in tables.items():
            rows.write.options(**STORED).partitionBy(*by).parquet(f"{folder}/{name}")
        if gone is not None:
            gone.select("key").distinct().write.parquet(f"{folder}/gone")
        self.folders.append(folder)
        self.hiding.append(gone is not None)

    def table(self, name: str, shape: str) -> DataFrame:
        """The rows of a table in all segments, hidden ones included, with the segment's number."""
        parts = [self.spark.read.schema(shape).parquet(f"{f}/{name}").withColumn("seg", F.lit(k)) for k, f in enumerate(self.folders)]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], f"{shape}, seg int")

    def live(self, rows: DataFrame, key: str = "key") -> DataFrame:
        """Without the rows that later segments hide. rows: seg and the key."""
        gone = [self.spark.read.schema(f"key {self.key}").parquet(f"{f}/gone").withColumn("_hides", F.lit(k)) for k, f in enumerate(self.folders) if self.hiding[k]]
        if not gone:
            return rows
        last = reduce(DataFrame.unionByName, gone).groupBy(F.col("key").alias("_gone")).agg(F.max("_hides").alias("_hides"))
        return rows.join(last, rows[key] == F.col("_gone"), "left").where("_hides IS NULL OR seg >= _hides").drop("_gone", "_hides")

    @property
    def many(self) -> bool:
        return len(self.folders) > MOST_SEGMENTS


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path can be reached."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
