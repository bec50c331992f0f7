"""Exact duplicates by an extendible-hash index on shared files (operator 13). DataFrame functions only.

A text's key is its 64-bit hash. The index is a table of entries in the shared
folder, one for each distinct text, in buckets by leading bits of the key, and a
directory from each possible prefix to its bucket. Buckets start as one; one that
holds more keys or bytes than a bucket may is split at its next bit, and when a
split goes deeper than the directory, that doubles: a counting pass over the keys
decides `STEP` doublings at once, and only as many passes are made as the fullest
bucket needs. Each bucket has one owner task, which gets the rows of its range of
keys, merges the copies by comparing their bytes, and chains the different texts of a
key. Keys of very many rows, of which there can be `HOT_KEYS` at most, are merged by
the tasks that read them before they move, so that no owner's share grows with the
number of copies. Rows find their entry by the key, and by the text itself where a
chain is longer than one.

`insert` adds a batch: buckets that it touches are rewritten in a new version,
split where they overflow, and all others stay as they are.

Cases: a null text counts as empty; texts are equal if their bytes are; of equal
texts the row with the largest id stays, null counting as less than any; rows that
repeat an id with the same text are copies too, and one of them stays; an id that
comes with different texts is in each text's group; a text that is longer than a bucket
may hold has one of its own; extra columns are not read by `groups`, and `drop_copies`
returns them; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.plans.materialize import Scratch
from weftgraph.sources.tables import table

#: What a bucket may hold, leading bits at most, doublings decided by one pass, and directory rows that may be broadcast.
BUCKET_KEYS = 1024
BUCKET_BYTES = 16 << 20
MAX_DEPTH = 28
STEP = 7
BROADCAST_SLOTS = 1 << 16
#: A key is hot that more than one of so many rows has, and more than so many rows.
HOT_KEYS = 1 << 16
HOT_ROWS = 64

_LEAST = -(2**63)


def bucket_at(key: Column, depth: int) -> Column:
    """The bucket of a key at a depth: a one, then the leading bits. The root is 1, a bucket's halves are 2b and 2b + 1."""
    return F.lit(1).cast("bigint") if depth == 0 else F.shiftrightunsigned(key, 64 - depth).bitwiseOR(F.lit(1 << depth))


def _overfull(keys: DataFrame, scratch: Scratch, most_keys: int, most_bytes: int) -> list[DataFrame]:
    """The buckets that must split, by passes of `STEP` depths. keys: key, size."""
    found = []
    for top in range(0, MAX_DEPTH, STEP):
        deep = min(top + STEP, MAX_DEPTH) - 1
        fine = keys.groupBy(bucket_at(F.col("key"), deep).alias("b")).agg(F.count("*").alias("n"), F.sum("size").alias("s"))
        # Counts of the deepest buckets add up to those above them.
        levels = fine.select(F.explode(F.array(*(F.shiftrightunsigned("b", deep - d) for d in range(top, deep + 1)))).alias("b"), "n", "s")
        load = levels.groupBy("b").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        full = scratch.put(load.where((F.col("n") > most_keys) | ((F.col("s") > most_bytes) & (F.col("n") > 1))).select("b"), "overfull")
        found.append(full)
        if full.where(F.col("b") >= 1 << deep).isEmpty():
            break
    return found


def directory(keys: DataFrame, scratch: Scratch, most_keys: int = BUCKET_KEYS, most_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, int]:
    """slot, bucket for each of 2**depth slots, and that depth: the buckets are the halves of split ones that aren't split themselves."""
    spark = keys.sparkSession
    split = reduce(DataFrame.unionByName, _overfull(keys, scratch, most_keys, most_bytes))
    halves = split.select(F.explode(F.array(F.col("b") * 2, F.col("b") * 2 + 1)).alias("b")).unionByName(spark.createDataFrame([(1,)], "b bigint"))
    leaves = halves.join(split, "b", "left_anti").withColumn("depth", F.length(F.bin("b")) - 1)
    leaves = scratch.put(leaves, "leaves")
    depth = leaves.agg(F.max("depth")).first()[0]
    width = F.expr(f"shiftleft(1L, {depth} - depth)")
    first = (F.col("b") - F.expr("shiftleft(1L, depth)")) * width
    slots = leaves.select(F.explode(F.sequence(first, first + width - 1)).alias("slot"), F.col("b").alias("bucket"))
    return scratch.put(slots, "directory"), depth


def with_bucket(rows: DataFrame, slots: DataFrame, depth: int) -> DataFrame:
    """Adds `bucket`, by the leading bits of `key`."""
    slot = F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0).cast("bigint")
    found = F.broadcast(slots) if 1 << depth <= BROADCAST_SLOTS else slots
    return rows.withColumn("slot", slot).join(found, "slot").drop("slot")


def _keys(rows: DataFrame, scratch: Scratch) -> DataFrame:
    return scratch.put(rows.groupBy("key").agg(F.max("size").alias("size"), F.sum("n").alias("n")), "keys")


def _single(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """bucket, key, text, n, keep_id, keep_row: a row as it is, or those of a task with the same hot text as one."""
    total = keys.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(keys.where(F.col("n") > max(HOT_ROWS, total // HOT_KEYS)).select("key"))
    order = F.coalesce("id", F.lit(_LEAST))
    many = rows.join(hot, "key", "left_semi").groupBy("bucket", "key", "text").agg(F.count("*").alias("n"), F.max("id").alias("keep_id"), F.max_by("row", order).alias("keep_row"))
    few = rows.join(hot, "key", "left_anti").select("bucket", "key", "text", F.lit(1).cast("bigint").alias("n"), F.col("id").alias("keep_id"), F.col("row").alias("keep_row"))
    return few.unionByName(many)


def _chained(rows: DataFrame) -> DataFrame:
    """What the owners of the buckets do: copies merged, keys in order, the texts of a key numbered by their bytes."""
    chain, order = Window.partitionBy("bucket", "key"), F.coalesce("keep_id", F.lit(_LEAST))
    owned = rows.repartition("bucket").groupBy("bucket", "key", "text").agg(F.sum("n").alias("n"), F.max("keep_id").alias("keep_id"), F.max_by("keep_row", order).alias("keep_row"))
    linked = owned.withColumn("link", F.row_number().over(chain.orderBy("text"))).withColumn("links", F.count("*").over(chain))
    return linked.withColumn("sha256", F.sha2("text", 256)).sortWithinPartitions("bucket", "key", "link")


def _key(text: Column) -> Column:
    return F.xxhash64(text)


@dataclass
class ExactIndex:
    """entries: bucket, key, link, links, text, sha256, n, keep_id, keep_row; slots and depth: the directory."""

    entries: DataFrame
    slots: DataFrame
    depth: int
    hashed: Callable[[Column], Column] = _key
    most_keys: int = BUCKET_KEYS
    most_bytes: int = BUCKET_BYTES

    @classmethod
    def build(cls, rows: DataFrame, scratch: Scratch, hashed: Callable[[Column], Column] = _key, most_keys: int = BUCKET_KEYS, most_bytes: int = BUCKET_BYTES) -> ExactIndex:
        """rows: id, row, key, size, text, a written table."""
        keys = _keys(rows.select("key", "size", F.lit(1).alias("n")), scratch)
        slots, depth = directory(keys, scratch, most_keys, most_bytes)
        entries = scratch.put(_chained(_single(with_bucket(rows, slots, depth), keys)), "entries")
        return cls(entries, slots, depth, hashed, most_keys, most_bytes)

    def insert(self, rows: DataFrame, scratch: Scratch) -> ExactIndex:
        """The index with a further batch. Entries of buckets that the batch doesn't meet are not rewritten."""
        own = _keys(rows.select("key", "size", F.lit(1).alias("n")), scratch)
        both = self.entries.select("key", F.octet_length("text").cast("bigint").alias("size"), "n").unionByName(own)
        slots, depth = directory(_keys(both, scratch), scratch, self.most_keys, self.most_bytes)
        met = scratch.put(with_bucket(own.select("key"), self.slots, self.depth).select("bucket").distinct(), "met")
        old = self.entries.join(met, "bucket", "left_semi").select("key", "text", "n", "keep_id", "keep_row")
        merged = with_bucket(old, slots, depth).unionByName(_single(with_bucket(rows, slots, depth), own))
        touched = scratch.put(_chained(merged), "entries")
        return ExactIndex(self.entries.join(met, "bucket", "left_anti").unionByName(touched), slots, depth, self.hashed, self.most_keys, self.most_bytes)

    def find(self, rows: DataFrame) -> DataFrame:
        """Each row with the entry of its text: keep_id, keep_row, n, sha256; rows without one are left out. rows: key, text and others."""
        got = ("key", "keep_id", "keep_row", "n", "sha256")
        plain = rows.drop("text", "size").join(self.entries.where("links = 1").select(*got), "key")
        chained = self.entries.where("links > 1")
        if chained.isEmpty():
            return plain
        return plain.unionByName(rows.drop("size").join(chained.select(*got, "text"), ["key", "text"]).drop("text"))


def keyed(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", hashed: Callable[[Column], Column] = _key) -> DataFrame:
    """id, row (a number of the row's own), key, size in bytes and text, written once."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return scratch.put(rows.select("id", F.monotonically_increasing_id().alias("row"), hashed(F.col("text")).alias("key"), F.octet_length("text").cast("bigint").alias("size"), "text"), "rows")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashed: Callable[[Column], Column] = _key, most_keys: int = BUCKET_KEYS, most_bytes: int = BUCKET_BYTES) -> DataFrame:
    """A row per row of `docs`: its id, keep_id, group_size, kept and text_sha256."""
    scratch = Scratch(docs.sparkSession, "exact")
    rows = keyed(docs, scratch, id_col, text_col, hashed)
    found = ExactIndex.build(rows, scratch, hashed, most_keys, most_bytes).find(rows)
    return found.select(F.col("id").alias(id_col), "keep_id", F.col("n").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"), F.col("sha256").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of `docs` for each text that differs, with all its columns."""
    scratch = Scratch(docs.sparkSession, "exact")
    numbered = scratch.put(docs.select(F.struct(*(f"`{c}`" for c in docs.columns)).alias("doc"), F.monotonically_increasing_id().alias("row")), "docs")
    text = F.coalesce(F.col("doc")[text_col], F.lit(""))
    rows = numbered.select(F.col("doc")[id_col].alias("id"), "row", _key(text).alias("key"), F.octet_length(text).cast("bigint").alias("size"), text.alias("text"))
    kept = ExactIndex.build(rows, scratch).entries.select(F.col("keep_row").alias("row"))
    return numbered.join(kept, "row", "left_semi").select("doc.*")


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of the table with the group of its text."""
    return groups(table(spark, sf_dir, "documents"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""
