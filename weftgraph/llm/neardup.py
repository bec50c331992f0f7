"""MinHash near-duplicates with sequential Bayesian verification (operator 1).

1. Every text becomes its set of word shingles; equal sets are one class, whose
   least doc_id represents it, so exact copies never meet as pairs.
2. A representative's signature of `PERMUTATIONS` min-hashes is cut into bands;
   representatives with an equal band share a bucket.
3. In each bucket all are compared with one pivot. A pair's signatures are read
   in batches: with m of n hashes equal, the posterior (uniform prior) that the
   similarity reaches the threshold is a binomial tail; once it falls below
   `MISS`, the pair is pruned. What survives is verified on the full sets.
4. Components of the verified links are found. A bucket whose members are all in
   one component is done. In the others, every member outside the bucket's
   largest component is compared with every member of another component, so no
   pair that could join two components is left out. Buckets are dealt to tasks
   in blocks of bounded size, in which pairs are pruned by the same posterior
   bounds and verified; only links leave a block, and a pair that shares several
   buckets is taken in the first. Where buckets would give very many pairs,
   further pivot rounds shrink them before, as long as that helps.

Banding misses a pair at similarity 0.8 with a probability of about 5e-6, and
pruning with at most `MISS` per batch.

Cases: a null or empty text, or one of white space, has an empty set and is
linked with nothing; a text of fewer words than a shingle has is one shingle;
rows of one doc_id count as one document, tied to the classes of all its texts;
rows with a null doc_id are never linked and are kept; equal and repeated rows
fall in one class; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import binary_column, by_size, column, mix, pieces, shingle_set
from weftgraph.plans.components import components
from weftgraph.plans.materialize import Scratch
from weftgraph.sources.tables import table

BANDS, ROWS = 40, 6
PERMUTATIONS = BANDS * ROWS
BATCH = 16
MISS = 1e-7
PERCENT = 80
#: Ids that may be broadcast to pick texts out of the table (16 MB); beyond it, a shuffled join does.
BROADCAST_IDS = 1_000_000
#: Residual pairs for each bucket row above which another pivot round is taken first, and the most such rounds.
CROWDED = 100
PIVOT_ROUNDS = 4
#: Rows of a bucket that one block compares with one another: those outside its largest component, and all.
OUTSIDE_ROWS, ALL_ROWS = 256, 512
#: Shingles of the same, of which each stands for some six bytes of text: a block holds few long texts.
OUTSIDE_SHINGLES, ALL_SHINGLES = 1_000_000, 2_000_000
#: Bytes of text that a task compares at once.
BATCH_BYTES = 8_000_000

MULTIPLIERS = mix(np.arange(1, PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """16 bits of the least value under each permutation."""
    least = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 256):
        np.minimum(least, (shingles[at : at + 256, None] * MULTIPLIERS).min(axis=0), out=least)
    return (mix(least) & np.uint64(0xFFFF)).astype(np.uint16)


def _sketcher(width: int):
    def run(batches):
        for batch in by_size(batches, "text", BATCH_BYTES):
            sizes, sums, xors, signatures = [], [], [], []
            for text in column(batch, "text"):
                shingles = shingle_set(text, width)
                sizes.append(len(shingles))
                sums.append(int(shingles.sum().astype(np.int64)) if len(shingles) else 0)
                xors.append(int(np.bitwise_xor.reduce(mix(shingles)).astype(np.int64)) if len(shingles) else 0)
                signatures.append(signature(shingles))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.array(xors, pa.int64()), binary_column(np.array(signatures, np.uint16).reshape(len(sizes), PERMUTATIONS))],
                ["doc_id", "n_shingles", "sum", "xor", "signature"],
            )

    return run


def least_matches(percent: int, miss: float = MISS) -> list[tuple[int, int]]:
    """(hashes read, least equal ones with which a pair stays): posterior tails of a uniform prior."""
    t = percent / 100
    out = []
    for n in range(BATCH, PERMUTATIONS + 1, BATCH):
        tail, m = 0.0, -1
        while tail < miss:  # P(similarity >= t | m of n equal) = P(Binomial(n + 1, t) <= m)
            m += 1
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append((n, m))
    return out


def unpruned(a: np.ndarray, b: np.ndarray, bounds: list[tuple[int, int]]) -> np.ndarray:
    """Which rows of two signature tables may still reach the threshold, batch after batch."""
    alive, equal = np.arange(len(a)), np.zeros(len(a), np.int64)
    for n, least in bounds:
        equal = equal + (a[alive, n - BATCH : n] == b[alive, n - BATCH : n]).sum(axis=1)
        stays = equal >= least
        alive, equal = alive[stays], equal[stays]
    return alive


def _pruner(percent: int):
    bounds = least_matches(percent)

    def run(batches):
        for batch in pieces(batches, 4096):
            a, b = (np.frombuffer(b"".join(column(batch, c)), np.uint16).reshape(-1, PERMUTATIONS) for c in ("signature_a", "signature_b"))
            yield batch.select(["a", "b"]).take(pa.array(unpruned(a, b, bounds), pa.int64()))

    return run


def _block(width: int, percent: int):
    """Links between the rows of a block that lie outside their bucket's largest component and all its rows."""
    bounds = least_matches(percent)

    def run(rows: pa.Table) -> pa.Table:
        ids, component, largest, size, band = (rows.column(c).to_numpy() for c in ("id", "component", "largest", "n_shingles", "band"))
        outside = rows.column("outside").to_numpy()
        signatures = np.frombuffer(b"".join(rows.column("signature").to_pylist()), np.uint16).reshape(-1, PERMUTATIONS)
        texts, sets = rows.column("text"), {}
        get = lambda k: sets[k] if k in sets else sets.setdefault(k, shingle_set(texts[k].as_py(), width))
        every = np.flatnonzero(~outside)
        found = []
        for x in np.flatnonzero(outside).tolist():
            y = every[(component[every] != component[x]) & ((component[every] == largest[x]) | (ids[every] > ids[x]))]
            y = y[100 * np.minimum(size[y], size[x]) >= percent * np.maximum(size[y], size[x])]
            y = y[unpruned(np.broadcast_to(signatures[x], (len(y), PERMUTATIONS)), signatures[y], bounds)]
            if len(y):
                shared = (signatures[y] == signatures[x]).reshape(len(y), BANDS, ROWS).all(axis=2)
                y = y[shared.argmax(axis=1) == band[x]]  # else another bucket has the pair before
            if not len(y):
                continue
            own, others = get(x), [get(k) for k in y.tolist()]
            at = np.searchsorted(own, joined := np.concatenate(others))
            at[at == len(own)] = 0
            common = np.add.reduceat(own[at] == joined, np.cumsum([0, *map(len, others[:-1])]), dtype=np.int64)
            linked = 100 * common >= percent * (len(own) + np.array([len(o) for o in others]) - common)
            found += [(int(ids[x]), int(ids[k])) for k in y[linked]]
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return run


def _verifier(width: int, percent: int):
    def run(batches):
        for batch in by_size(batches, "text_a", BATCH_BYTES):
            keep, known = [], {}
            for b, text_a, text_b in zip(column(batch, "b"), column(batch, "text_a"), column(batch, "text_b"), strict=True):
                one = shingle_set(text_a, width)
                if (b, text_b) not in known:
                    known[b, text_b] = shingle_set(text_b, width)
                two = known[b, text_b]
                shared = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(100 * shared >= percent * (len(one) + len(two) - shared) and shared > 0)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


class _Search:
    """The written tables of one run and the steps over them."""

    def __init__(self, docs: DataFrame, width: int, percent: int, label: str) -> None:
        self.spark, self.width, self.percent = docs.sparkSession, width, percent
        self.scratch = Scratch(self.spark, label)
        self.docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
        self.sketches = self.scratch.put(
            self.docs.mapInArrow(_sketcher(width), "doc_id bigint, n_shingles bigint, `sum` bigint, `xor` bigint, signature binary"), "sketches"
        )
        key = ["n_shingles", "sum", "xor"]
        given = self.sketches.where("n_shingles > 0 AND doc_id IS NOT NULL")
        # Equal sets have equal hashes, so these can be part of the key.
        self.classes = self.scratch.put(given.groupBy(*key, "signature").agg(F.min("doc_id").alias("id")), "classes")
        band = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.col("signature").substr(k * (2 * ROWS) + 1, F.lit(2 * ROWS)))))
        bands = self.classes.select("id", "n_shingles", band.alias("band", "bucket"))
        shared = bands.groupBy("bucket").agg(F.min("id").alias("pivot"), F.max("id").alias("last")).where("pivot <> last").select("bucket", "pivot")
        self.buckets = self.scratch.put(bands.join(shared, "bucket"), "buckets")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose full sets reach the threshold."""
        side = lambda s: self.classes.select(F.col("id").alias(s), F.col("n_shingles").alias(f"n_{s}"), F.col("signature").alias(f"signature_{s}"))
        close = 100 * F.least("n_a", "n_b") >= self.percent * F.greatest("n_a", "n_b")  # else the sizes alone rule it out
        near = self.scratch.put(pairs.join(side("a"), "a").join(side("b"), "b").where(close).mapInArrow(_pruner(self.percent), "a bigint, b bigint"), "near")
        texts = self.texts(near.select(F.explode(F.array("a", "b")).alias("doc_id")), 2 * near.count())
        one, two = (texts.select(F.col("doc_id").alias(s), F.col("text").alias(f"text_{s}")) for s in "ab")
        links = self.scratch.put(near.join(one, "a").join(two, "b").mapInArrow(_verifier(self.width, self.percent), "a bigint, b bigint"), "links")
        self.scratch.drop(near, texts)
        return links

    def texts(self, ids: DataFrame, most: int) -> DataFrame:
        """Texts of the ids, of which there are `most` at most."""
        ids = ids.distinct()
        return self.scratch.put(self.docs.join(F.broadcast(ids) if most <= BROADCAST_IDS else ids, "doc_id", "left_semi"), "texts")

    def verified_in_blocks(self, rows: DataFrame, n: int) -> DataFrame:
        """Links between components within buckets. rows: the residue, of n rows."""
        blocks = lambda count, most, size, most_size: F.greatest(F.ceil(F.col(count) / most), F.ceil(F.col(size) / most_size)).cast("int")
        given = rows.withColumns({"i": blocks("apart", OUTSIDE_ROWS, "size_apart", OUTSIDE_SHINGLES), "j": blocks("all", ALL_ROWS, "size_all", ALL_SHINGLES)})
        each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        dealt = lambda c, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(c)).cast("int")
        columns = ["bucket", "band", "id", "n_shingles", "component", "largest"]
        x = given.where("component <> largest").select(*columns, dealt("i", 0).alias("x"), each("j").alias("y"), F.lit(True).alias("outside"))
        y = given.select(*columns, dealt("j", 1).alias("y"), each("i").alias("x"), F.lit(False).alias("outside"))
        texts = self.texts(rows.select(F.col("id").alias("doc_id")), n)
        full = x.unionByName(y).join(self.classes.select("id", "signature"), "id").join(texts.withColumnRenamed("doc_id", "id"), "id")
        links = self.scratch.put(full.groupBy("bucket", "x", "y").applyInArrow(_block(self.width, self.percent), "a bigint, b bigint"), "links")
        self.scratch.drop(texts)
        return links

    def residue(self, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows of the buckets that hold several components, with each bucket's size and largest component."""
        rows = self.buckets.join(groups, F.col("id") == F.col("node"), "left").select("bucket", "band", "id", "n_shingles", F.coalesce("component", "id").alias("component"))
        sizes = rows.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("size"))
        split = (
            sizes.groupBy("bucket").agg(F.max(F.struct("n", "component", "size")).alias("most"), F.sum("n").alias("all"), F.sum("size").alias("size_all"), F.count("*").alias("parts")).where("parts > 1")
            .select("bucket", "all", "size_all", F.col("most.component").alias("largest"), (F.col("all") - F.col("most.n")).alias("apart"), (F.col("size_all") - F.col("most.size")).alias("size_apart"))
        )
        rows = self.scratch.put(rows.join(split, "bucket"), "residue")
        total = rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.when(F.col("component") != F.col("largest"), F.col("all"))), F.lit(0)).alias("pairs")).first()
        return rows, total

    def groups(self, links: DataFrame) -> DataFrame:
        return components(self.scratch, links, "a", "b").select(F.col("id").alias("node"), "component")

    def run(self) -> DataFrame:
        """(id, component) of the representatives that are linked to another."""
        links = self.verified(self.buckets.where("id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct())
        # A doc_id with several texts ties their classes.
        members = self.sketches.where("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", "n_shingles", "sum", "xor")
        several = members.groupBy("doc_id").agg(F.min(F.xxhash64("n_shingles", "sum", "xor")).alias("x"), F.max(F.xxhash64("n_shingles", "sum", "xor")).alias("y")).where("x <> y").select("doc_id")
        ties = members.join(several, "doc_id").join(self.classes.select("id", "n_shingles", "sum", "xor"), ["n_shingles", "sum", "xor"]).select(F.col("id").alias("a"), F.col("doc_id").alias("b"))
        links = links.unionByName(self.scratch.put(ties, "ties"))
        groups = self.groups(links)
        rows, total = self.residue(groups)
        for turn in range(PIVOT_ROUNDS):
            if total["pairs"] <= CROWDED * total["rows"]:
                break
            pivots = rows.where("component <> largest").groupBy("bucket").agg(F.min_by("id", F.xxhash64("id", F.lit(turn))).alias("b"), F.min_by("component", F.xxhash64("id", F.lit(turn))).alias("side"))
            more = rows.join(pivots, "bucket").where("component <> side").select(F.col("id").alias("a"), "b").distinct()
            links = links.unionByName(self.verified(more))
            self.scratch.drop(rows)
            groups = self.groups(links)
            before = total["pairs"]
            rows, total = self.residue(groups)
            if total["pairs"] > 0.8 * before:
                break
        if total["pairs"]:
            links = links.unionByName(self.verified_in_blocks(rows, total["rows"]))
            groups = self.groups(links)
        return groups.withColumnRenamed("node", "id")

    def documents(self) -> DataFrame:
        """doc_id, n_shingles, component_id, kept for each row of the table."""
        key = ["n_shingles", "sum", "xor"]
        of_class = self.classes.select("id", *key).join(self.run(), "id", "left").select(*key, F.coalesce("component", "id").alias("component"))
        rows = self.sketches.select("doc_id", *key).join(of_class, key, "left")
        return rows.select(
            "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")
        ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row: near copies share the least doc_id among them."""
    return _Search(docs, width, percent, "neardup").documents()


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = PERCENT) -> DataFrame:
    """The documents without the near copies of an earlier doc_id, all columns kept."""
    gone = near_duplicates(docs, width, percent).where("NOT kept").select(F.col("doc_id").alias("_weft_gone")).distinct()
    gone = Scratch(docs.sparkSession, "neardup-gone").put(gone, "gone")
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, F.col("doc_id") == F.col("_weft_gone"), "left_anti")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of the whole table, over four-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=4)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE = rf"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingled AS (
  SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM worded
), sized AS (
  SELECT doc_id, count(*) AS n FROM shingled GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM shingled a JOIN shingled b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), linked AS (
  SELECT a, b FROM shared JOIN sized x ON x.doc_id = a JOIN sized y ON y.doc_id = b WHERE 100 * common >= {PERCENT} * (x.n + y.n - common)
), ways AS (
  SELECT a AS x, b AS y FROM linked UNION SELECT b, a FROM linked
), reached(doc_id, r) AS (
  SELECT x, y FROM ways UNION SELECT doc_id, y FROM reached JOIN ways ON x = r
), least AS (
  SELECT doc_id, min(r) AS r FROM reached GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(least(d.doc_id, r), d.doc_id) AS component_id, d.doc_id = coalesce(least(d.doc_id, r), d.doc_id) AS kept
FROM documents d LEFT JOIN sized USING (doc_id) LEFT JOIN least USING (doc_id)
"""
