"""Vector top-k with expansion, and ranked full-text search.

Vectors are asked of an approximate index (`vectors`) or scanned exactly: nodes keep them
scaled to length 1, so a score is one product, and a top-k keeps k rows per task.

The text index holds the postings in blocks. Texts are dealt into lots of about `LOT_TEXTS`
texts of like length; a block is what one lot has of one term, with the largest count
of the term and the least length of a text, which bound the term's weight for the whole
block. When an index is made, each task makes lots of the texts that it reads, counts them and writes
their blocks, so that no text moves. A ranked question reads the bounds of its terms' blocks first, then the texts of the
`FIRST_LOTS` most promising lots, and after that only lots whose bound reaches the worst
score among the best so far; where those are many, from more lots first. Postings lie in folders by the term's hash. A batch of texts
is a segment with its own blocks and totals, and with what the texts that it replaces had
held, so that all numbers equal those of an index made anew.
"""

from __future__ import annotations

import math
import unicodedata
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from weftgraph import schema as X
from weftgraph.operators.filters import in_repos
from weftgraph.operators.segments import Segments
from weftgraph.operators.vectors import VectorIndex, dot, unit  # noqa: F401  `unit` belongs to the surface of this module
from weftgraph.plans.adjacency import Adjacency, Edges
from weftgraph.plans.materialize import Scratch

K1, B = 1.2, 0.75
#: Folders of a stored text index, texts of a lot, lots that a ranked question reads before it knows a bound.
FOLDERS = 8
LOT_TEXTS = 128
FIRST_LOTS = 32
#: Words of the texts that one task puts into blocks at a time, which come to some 200 MB of its memory.
TASK_WORDS = 2_000_000
#: Words of questions in lots that may be broadcast to the blocks; beyond it blocks are shuffled to them.
BROADCAST_WANTED = 200_000
#: Rounds in which a bound is looked for, each over so many times more lots; after them all lots that reach it are joined.
ROUNDS = 3
GROWTH = 8
#: Scores are rounded to six places; a bound may miss by less than this.
SLACK = 1e-6


def top_k(nodes: DataFrame, vector: Sequence[float], k: int = X.TOP_K, key: str = "id") -> DataFrame:
    """The k nodes nearest to a vector with their score, (1 + cosine) / 2, ties by key.

    nodes: `unit`, the scaled vectors; a node without an embedding has none.
    """
    length = sum(float(v) ** 2 for v in vector) ** 0.5
    query = F.array(*(F.lit(float(v) / length if length else None).cast("double") for v in vector))
    return nodes.where(F.size("embedding") > 0).withColumn("score", (1 + dot(F.col("unit"), query)) / 2).drop("unit").orderBy(F.desc_nulls_last("score"), key).limit(k)


@dataclass
class Vectors:
    """Vectors in a table of their own (id, embedding, unit), scanned for each question: exact, as a scan of nodes that hold them."""

    rows: DataFrame

    def top_k(self, vector: Sequence[float], k: int = X.TOP_K) -> DataFrame:
        return top_k(self.rows, vector, k).select("id", "score")


def expand(hits: DataFrame, nodes: DataFrame, edges: DataFrame | Adjacency | Edges, repos: Sequence[str] | None = None, most: int = X.CONNECTED_MOST) -> DataFrame:
    """Adds `connected`: at most `most` distinct called or used nodes with code, in the order of name, path and code.

    They are cut to `most` within each task before anything is collected. Of stored adjacency
    only the hits' buckets are read.
    """
    if isinstance(edges, Adjacency | Edges):
        # Of top_k rows; written, as Spark then knows that they are few, and doesn't move nodes to them.
        edges = Scratch(nodes.sparkSession, "near").put(edges.edges_of([r["id"] for r in hits.select("id").collect()], True), "edges")
    ends = in_repos(nodes.where(F.col("label").isin("Function", "File") & F.col("code").isNotNull()), repos)
    near = (
        edges.where(F.col("type").isin("CALLS", "DEPENDS_ON")).select("src", "dst").join(hits.select(F.col("id").alias("src")), "src", "left_semi")
        .join(ends.select(F.col("id").alias("dst"), "name", F.coalesce("filepath", "path").alias("path"), "code"), "dst")
        .withColumn("_n", F.dense_rank().over(Window.partitionBy("src").orderBy("name", "path", "code"))).where(F.col("_n") <= most)
        .select("src", "name", "path", "code").distinct()
        .groupBy("src").agg(F.array_sort(F.collect_list(F.struct("name", "path", "code"))).alias("connected"))
    )
    return hits.join(near, hits["id"] == near["src"], "left").drop("src").withColumn("connected", F.coalesce("connected", F.array().cast(X.CONNECTED)))


def vector_search(
    nodes: DataFrame, edges: DataFrame | Adjacency | Edges, vector: Sequence[float], k: int = X.TOP_K, repos: Sequence[str] | None = None, prefilter: bool = False, index: VectorIndex | Vectors | None = None,
) -> DataFrame:
    """The k nearest functions, then the repository filter, then their neighbours; best first.

    As the filter comes after the top k, fewer may be left; `prefilter` puts it before, and then
    all vectors are scanned. With an `index` of the functions, nodes need no vectors.
    """
    functions = nodes.where("label = 'Function'")
    if index is None or (prefilter and repos):
        hits = top_k(in_repos(functions, repos) if prefilter else functions, vector, k)
    else:
        found = index.top_k(vector, k).collect()  # k rows
        scores = nodes.sparkSession.createDataFrame(found, "id string, score double")
        hits = functions.where(F.col("id").isin([r["id"] for r in found])).join(F.broadcast(scores), "id")
    return expand(in_repos(hits.where("code IS NOT NULL"), repos), nodes, edges, repos).orderBy(F.desc("score"), "id")


def terms_of(text: Column) -> Column:
    """Runs of letters, marks and digits of any script, in lower case."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), lambda t: t != "")


def words_of(question: str) -> list[str]:
    """The same of a question, each word once."""
    return list(dict.fromkeys("".join(c if unicodedata.category(c)[0] in "LMN" else " " for c in question.lower()).split()))


def _counted(docs: DataFrame, text: Column) -> DataFrame:
    """key, length and terms of each text, as one text with spaces between them, which takes half of an array's room."""
    terms = docs.select("key", terms_of(F.coalesce(text, F.lit(""))).alias("terms"))
    return terms.select("key", F.size("terms").cast("bigint").alias("length"), F.array_join("terms", " ").alias("terms"))


def _postings(counted: DataFrame, *by: str) -> DataFrame:
    """term, key, tf and length; counted per text within its task before anything moves. by: what the texts are dealt by."""
    each = counted.select("key", "length", *by, F.explode(F.split("terms", " ")).alias("term")).where("term <> ''")
    return each.groupBy(*by, "term", "key", "length").agg(F.count("*").alias("tf"))


def _parts(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Texts together, as many as come to `most` words, or one text."""
    held, words = [], 0
    for batch in batches:
        lengths, start = batch["length"].to_numpy(zero_copy_only=False), 0
        for end in range(1, len(lengths) + 1):
            words += int(lengths[end - 1])
            if words >= most:
                yield pa.Table.from_batches([*held, batch.slice(start, end - start)])
                held, words, start = [], 0, end
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def _lots(texts: pa.Table, lot_texts: int, first: int) -> pa.Table:
    """The same in order of lot and key, with the number of their lot, from `first` on: texts of like length, `lot_texts` at most."""
    kind = np.floor(2 * np.log2(texts["length"].to_numpy() + 1)).astype(np.int64)
    order = np.argsort(kind, kind="stable")
    places = np.arange(len(kind)) - np.searchsorted(kind[order], kind[order])  # within its class
    starts = places % lot_texts == 0
    lots = np.empty(len(kind), np.int64)
    lots[order] = first + np.cumsum(starts) - 1
    return texts.append_column("lot", pa.array(lots)).sort_by([("lot", "ascending"), ("key", "ascending")])


def _made_blocks(lot_texts: int, most: int, shape: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks (term, lot, n, most, least, texts) of batches of key, length and terms, within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot = TaskContext.get().partitionId() << 36  # no two tasks share a lot
        for part in _parts(batches, most):
            texts = _lots(part.filter(pc.greater(part["length"], 0)), lot_texts, lot)
            if not len(texts):
                continue
            lots, lengths = texts["lot"].to_numpy(), texts["length"].to_numpy()
            lot = int(lots[-1]) + 1
            words = pc.list_flatten(pc.split_pattern(texts["terms"], " ")).combine_chunks().dictionary_encode()
            # A number for each word of a text, in order of word, lot and key.
            at, tf = np.unique(words.indices.to_numpy().astype(np.int64) * len(texts) + np.repeat(np.arange(len(texts)), lengths), return_counts=True)
            term, place = np.divmod(at, len(texts))
            starts = np.flatnonzero(np.r_[True, (np.diff(term) != 0) | (np.diff(lots[place]) != 0)])
            ends = pa.array(np.r_[starts, len(at)].astype(np.int32))
            held = pa.StructArray.from_arrays([texts["key"].combine_chunks().take(pa.array(place)), pa.array(tf.astype(np.int64)), pa.array(lengths[place])], ["key", "tf", "length"])
            columns = [
                words.dictionary.take(pa.array(term[starts])), pa.array(lots[place[starts]]), pa.array(np.diff(np.r_[starts, len(at)])), pa.array(np.maximum.reduceat(tf, starts).astype(np.int64)),
                pa.array(np.minimum.reduceat(lengths[place], starts)), pa.ListArray.from_arrays(ends, held),
            ]
            yield from pa.Table.from_arrays(columns, ["term", "lot", "n", "most", "least", "texts"]).cast(shape).to_batches(10_000)

    return run


def _share(tf: Column, length: Column, average: float) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(average)))


def _weight(n: int, df: Column) -> Column:
    return F.log(1 + (F.lit(n) - df + 0.5) / (df + 0.5))


def _like_length(length: Column) -> Column:
    """Texts of like length: two classes for each doubling."""
    return F.floor(2 * F.log2(length + 1))


def _folder(term: Column) -> Column:
    return (F.crc32(term) % FOLDERS).cast("int")


@dataclass
class TextIndex:
    """Blocks of postings (term, lot, n, most, least, texts), and the totals of each segment. `key` names the texts' key.

    named: SQL of `key` that makes the key that questions rank by and return, where a shorter one is stored.
    """

    key: str
    store: Segments
    named: str = "key"
    _total: tuple[int, Row] | None = None

    def _totals(self) -> DataFrame:
        """The number of texts and of their words, over all segments."""
        return self.store.table("totals", self._shapes["totals"]).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("length"))

    @property
    def _shapes(self) -> dict[str, str]:
        return {
            "blocks": f"term string, lot bigint, n bigint, most bigint, least bigint, texts array<struct<key: {self.store.key}, tf: bigint, length: bigint>>, folder int",
            "totals": "n bigint, length bigint", "lost": "term string, n bigint, folder int",
        }

    @classmethod
    def build(cls, docs: DataFrame, key: str, text: Column, folder: str, named: str = "key") -> TextIndex:
        """An index of all texts in a new folder; texts with a null key are left out."""
        out = cls(key, Segments(docs.sparkSession, docs.schema[key].dataType.simpleString()), named)
        out.add(docs, text, folder)
        return out

    def add(self, docs: DataFrame, text: Column, folder: str, replaced: DataFrame | None = None) -> None:
        """A segment of texts in a new folder. replaced: the rows that these replace, as they were indexed."""
        given = docs.withColumn("key", F.col(self.key)).where("key IS NOT NULL")
        counted = _counted(given, text)
        # The words are not kept: as a table they would take more room than the index.
        counted.select("key", "length").write.option("compression", "zstd").parquet(f"{folder}/terms")
        lengths = self.store.spark.read.schema(counted.select("key", "length").schema).parquet(f"{folder}/terms")
        shape = ", ".join(x for x in self._shapes["blocks"].split(", ") if x != "folder int")
        as_arrow = to_arrow_schema(self.store.spark.createDataFrame([], shape).schema)
        made = counted.mapInArrow(_made_blocks(LOT_TEXTS, TASK_WORDS, as_arrow), shape)
        blocks = made.withColumn("folder", _folder(F.col("term"))).sortWithinPartitions("folder", "term", "lot")
        total = lengths.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("length"))
        tables = {"blocks": (blocks, ["folder"]), "totals": (total, [])}
        if replaced is not None:
            old = _counted(replaced.withColumn("key", F.col(self.key)), text)
            lost = old.select(F.explode(F.array_distinct(F.split("terms", " "))).alias("term")).where("term <> ''").groupBy("term").agg(F.count("*").alias("n"))
            size = old.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("length")).select((-F.col("n")).alias("n"), (-F.col("length")).alias("length"))
            tables["lost"] = (lost.withColumn("folder", _folder(F.col("term"))).repartition("folder"), ["folder"])
            tables["totals"] = (tables["totals"][0].unionByName(size), [])
        else:
            tables["lost"] = (self.store.spark.createDataFrame([], self._shapes["lost"]), ["folder"])
        self.store.write(folder, tables, None if replaced is None else replaced.select(F.col(self.key).alias("key")))

    def _tables(self, rows: DataFrame, texts: DataFrame, postings: Callable[[DataFrame], DataFrame]) -> dict[str, tuple[DataFrame, Sequence[str]]]:
        """Postings in blocks. rows: key, length and what `postings` makes (lot, term, key, tf, length) of, once they are dealt by lot; texts: key and length of every text."""
        # As many classes as a length has doublings, twice.
        classes = texts.groupBy(_like_length(F.col("length")).alias("class")).agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("length")).collect()
        n, words = sum(r["n"] for r in classes), sum(r["length"] for r in classes)
        spark = self.store.spark
        lots = spark.createDataFrame([(r["class"], math.ceil(r["n"] / LOT_TEXTS)) for r in classes], "class bigint, lots bigint")
        placed = rows.withColumn("class", _like_length(F.col("length"))).join(F.broadcast(lots), "class").withColumn("lot", F.shiftleft("class", 40) + F.pmod(F.xxhash64("key"), "lots")).drop("class", "lots")
        held = F.struct("key", F.col("tf").cast("bigint").alias("tf"), "length")
        counted = postings(placed.repartition(max(1, math.ceil(words / TASK_WORDS)), "lot"))
        blocks = counted.groupBy("lot", "term").agg(F.count("*").alias("n"), F.max("tf").alias("most"), F.min("length").alias("least"), F.array_sort(F.collect_list(held)).alias("texts"))
        # Each task has a file in each folder, where rows stand by term, so that a reader skips what it doesn't ask.
        dealt = blocks.select("term", "lot", "n", "most", "least", "texts", _folder(F.col("term")).alias("folder")).sortWithinPartitions("folder", "term", "lot")
        totals = spark.createDataFrame([(n, words)], "n bigint, length bigint")
        return {"blocks": (dealt, ["folder"]), "totals": (totals.coalesce(1), [])}

    def postings(self) -> DataFrame:
        """term, key, tf and length of the live texts."""
        rows = self.store.table("blocks", self._shapes["blocks"]).select("seg", "term", F.inline("texts"))
        return self.store.live(rows).select("term", "key", "tf", "length")

    def save(self, folder: str) -> TextIndex:
        """A copy in a new folder, all segments in one; nothing is cut into words again."""
        postings = self.postings()
        out = TextIndex(self.key, Segments(self.store.spark, self.store.key), self.named)
        tables = out._tables(postings, postings.select("key", "length").distinct(), lambda dealt: dealt)
        out.store.write(folder, tables | {"totals": (self._totals().coalesce(1), []), "lost": (self.store.spark.createDataFrame([], self._shapes["lost"]), ["folder"])})
        return out

    @classmethod
    def load(cls, spark: SparkSession, folder: str, key: str, kind: str = "string") -> TextIndex:
        return cls(key, Segments(spark, kind, [folder], [False]))

    def _of(self, terms: Sequence[str], name: str) -> DataFrame:
        """The rows of some terms, from their folders only."""
        folders = sorted({zlib.crc32(t.encode()) % FOLDERS for t in terms})
        return self.store.table(name, self._shapes[name]).where(F.col("folder").isin(folders) & F.col("term").isin(*terms))

    def _size(self) -> tuple[int, float]:
        """The number of texts and their average length."""
        if self._total is None or self._total[0] != len(self.store.folders):
            self._total = len(self.store.folders), self._totals().first()
        total = self._total[1]
        return total["n"], total["length"] / total["n"] if total["n"] and total["length"] else 1.0

    def _known(self, terms: Sequence[str]) -> tuple[DataFrame, int, float]:
        """df of each term, the number of texts and their average length."""
        seen = self._of(terms, "blocks").select("term", "n").unionByName(self._of(terms, "lost").select("term", (-F.col("n")).alias("n")))
        df = seen.groupBy("term").agg(F.sum("n").alias("df")).where("df > 0").collect()  # a row per word of the question
        return self.store.spark.createDataFrame(df, "term string, df bigint"), *self._size()

    def _scores(self, blocks: DataFrame, weights: DataFrame, average: float) -> DataFrame:
        """key and score of the texts of blocks. weights: term and its weight."""
        rows = self.store.live(blocks.select("seg", "term", F.inline("texts"))).join(F.broadcast(weights), "term")
        scores = rows.groupBy("key").agg(F.round(F.sum(F.col("weight") * _share(F.col("tf"), F.col("length"), average)), 6).alias("score"))
        return scores.select(F.expr(self.named).alias(self.key), "score")

    def _bounds(self, blocks: DataFrame, weights: DataFrame, average: float) -> DataFrame:
        """The most that a text of each lot can score."""
        return blocks.select("seg", "term", "lot", "most", "least").join(F.broadcast(weights), "term").groupBy("seg", "lot").agg(F.sum(F.col("weight") * _share(F.col("most"), F.col("least"), average)).alias("bound"))

    def rank(self, terms: Sequence[str], limit: int | None = X.FULLTEXT_LIMIT) -> DataFrame:
        """Live texts that hold any of the terms, ranked; ties by key. Without a limit all blocks are read."""
        terms = list(dict.fromkeys(terms)) or [""]
        df, n, average = self._known(terms)
        weights = df.select("term", _weight(n, F.col("df")).alias("weight"))
        blocks = self._of(terms, "blocks")
        if limit is None:
            return self._scores(blocks, weights, average).orderBy(F.desc("score"), self.key)
        worth = self._worth(blocks, weights, average, limit)
        return self._scores(blocks.join(worth, ["seg", "lot"], "left_semi"), weights, average).orderBy(F.desc("score"), self.key).limit(limit)

    def _worth(self, blocks: DataFrame, weights: DataFrame, average: float, limit: int) -> DataFrame:
        """The lots that may hold one of the best `limit` texts, found from the most promising ones, more of them each round."""
        spark = self.store.spark
        bounds = Scratch(spark, "bounds").put(self._bounds(blocks, weights, average), "bounds")
        size = FIRST_LOTS
        for _ in range(ROUNDS):
            first = bounds.orderBy(F.desc("bound"), "seg", "lot").limit(size).collect()
            lots = F.broadcast(spark.createDataFrame([(r["seg"], r["lot"]) for r in first], "seg int, lot bigint"))
            best = self._scores(blocks.join(lots, ["seg", "lot"], "left_semi"), weights, average).orderBy(F.desc("score")).limit(limit).collect()
            least = best[-1]["score"] - SLACK if len(best) == limit else 0.0
            if len(first) < size or first[-1]["bound"] < least:
                break  # no lot but these is worth a look
            size *= GROWTH
        return bounds.where(F.col("bound") >= least).select("seg", "lot")

    def skipped(self, terms: Sequence[str], limit: int = X.FULLTEXT_LIMIT) -> tuple[int, int]:
        """Blocks of the terms, and how many of these a ranked question doesn't read."""
        df, n, average = self._known(terms)
        weights, blocks = df.select("term", _weight(n, F.col("df")).alias("weight")), self._of(terms, "blocks")
        worth = self._worth(blocks, weights, average, limit)
        return blocks.count(), blocks.join(worth, ["seg", "lot"], "left_anti").count()

    def ask(self, question: str, limit: int | None = X.FULLTEXT_LIMIT) -> DataFrame:
        """Ranked search for the plain words of a question."""
        return self.rank(words_of(question), limit)

    def ask_each(self, questions: DataFrame, question: str, text: Column, limit: int = X.FULLTEXT_LIMIT) -> DataFrame:
        """The same for every row of a table: the best texts of each question, with their score and rank.

        The steps and their number are the same for any number of questions: the bounds of all (question,
        lot), the scores of each question's `FIRST_LOTS` best lots, and then only the lots that can
        reach the worst of its best. Blocks meet the questions' words in equi joins, bounds without their texts.
        Questions without a known word have no rows; rows with a null key are left out, rows of one key are one
        question; of repeated words one counts.
        """
        scratch, (n, average) = Scratch(self.store.spark, "questions"), self._size()
        asked = questions.where(F.col(question).isNotNull()).select(F.col(question).alias("question"), F.explode(terms_of(text)).alias("term")).distinct()
        asked = scratch.put(asked, "asked").withColumn("folder", _folder(F.col("term")))
        blocks, lost = (self.store.table(name, self._shapes[name]) for name in ("blocks", "lost"))
        words = asked.select("folder", "term").distinct()
        seen = blocks.select("folder", "term", "n").unionByName(lost.select("folder", "term", (-F.col("n")).alias("n"))).join(words, ["folder", "term"], "left_semi")
        df = seen.groupBy("folder", "term").agg(F.sum("n").alias("df")).where("df > 0")
        weights = scratch.put(asked.join(df, ["folder", "term"]).select("question", "folder", "term", _weight(n, F.col("df")).alias("weight")), "weights")
        bound = F.sum(F.col("weight") * _share(F.col("most"), F.col("least"), average)).alias("bound")
        bounds = scratch.put(blocks.select("seg", "folder", "term", "lot", "most", "least").join(weights, ["folder", "term"]).groupBy("question", "seg", "lot").agg(bound), "bounds")

        def best(lots: DataFrame) -> DataFrame:
            wanted = lots.select("question", "seg", "lot").join(weights, "question")
            if wanted.limit(BROADCAST_WANTED + 1).count() <= BROADCAST_WANTED:
                wanted = F.broadcast(wanted)
            rows = self.store.live(blocks.join(wanted, ["seg", "folder", "term", "lot"]).select("question", "seg", "weight", F.inline("texts")))
            scores = rows.groupBy("question", "key").agg(F.round(F.sum(F.col("weight") * _share(F.col("tf"), F.col("length"), average)), 6).alias("score")).withColumn("key", F.expr(self.named))
            rank = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("score"), "key"))
            return scores.withColumn("rank", rank).where(F.col("rank") <= limit)

        place = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("bound"), "seg", "lot"))
        first = best(scratch.put(bounds.withColumn("_n", place).where(F.col("_n") <= FIRST_LOTS), "first"))
        # A question with fewer than `limit` texts so far has no bound yet: all its lots are read.
        least = first.groupBy("question").agg(F.when(F.count("*") == limit, F.min("score") - SLACK).alias("least"))
        worth = bounds.join(least, "question", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least")))
        return best(scratch.put(worth, "worth")).select(F.col("question").alias(question), F.col("key").alias(self.key), "score", "rank")


def search(docs: DataFrame, key: str, text: Column, question: str, limit: int | None = X.FULLTEXT_LIMIT) -> DataFrame:
    """The same over texts that have no stored index, in passes over all of them."""
    terms = words_of(question) or [""]
    counted = _counted(docs.withColumn("key", F.col(key)), text)
    total = counted.agg(F.count("*").alias("n"), F.avg("length").alias("average")).first()
    posts = _postings(counted.withColumn("terms", F.array_join(F.filter(F.split("terms", " "), lambda t: t.isin(*terms)), " ")))
    df = posts.groupBy("term").agg(F.count("*").alias("df"))  # as many rows as there are words in the question
    scored = posts.join(F.broadcast(df), "term").groupBy(F.col("key").alias(key)).agg(F.round(F.sum(_weight(total["n"], F.col("df")) * _share(F.col("tf"), F.col("length"), total["average"] or 1.0)), 6).alias("score"))
    ranked = scored.orderBy(F.desc("score"), key)
    return ranked if limit is None else ranked.limit(limit)
