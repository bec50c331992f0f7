"""An index for case-insensitive substrings: positional runs of three characters.

Lower-cased texts of one field are put one after another in blocks of about `BLOCK_CHARS`
code points, each after a gap. For each gram and block the index has the places where the
gram stands, ascending, in folders by the gram; a folder of its own has the blocks' texts:
their keys and where they begin. A word of three characters or more is covered
by grams at steps of three and one at its end; it stands exactly where all
of them stand at their distances, which none do over a gap, so a match needs no look at the text.
Only places and a row per block move when a word is looked for. What filters and orders need of a node
(label, repository, whether it has code and how much) stands in a narrow table of its own.

A batch is a segment that hides older rows of its keys. Words of fewer than three
characters have no gram: `holding` takes them by a scan of the texts, as all words
without an index.

Cases: a null field holds nothing; the empty word is in every field, by the scan; words
are compared as Spark lower-cases them; keys are unique; a null key is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.operators.filters import contains_any_ci
from weftgraph.operators.segments import Segments
from weftgraph.plans.materialize import Scratch

GRAM = 3
#: Folders of grams: a prime, so that all three characters tell.
FOLDERS = 7
#: Folder of the blocks' texts.
NAMED = FOLDERS
#: Code points of a block, unless one text alone has more.
BLOCK_CHARS = 2_000_000
#: Code points of the texts whose grams one task sorts and writes, some 350 MB of its memory at most.
TASK_CHARS = 3_000_000
#: Blocks with hits that are broadcast to the blocks' texts; beyond it, both are shuffled.
FEW_BLOCKS = 1000
#: Rows that a question may name one by one; beyond it, it is joined.
MOST_NAMED = 1000

_CUT = "gram bigint, field string, block string, at array<int>, ids array<string>"
_SHAPES = {"grams": "gram bigint, field string, block string, at array<int>, ids array<string>, folder int", "keys": "id string, label string, repo string, coded boolean, size bigint"}


def grams_of(text: str) -> np.ndarray:
    """A number for each run of three code points, in order."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:] if len(codes) >= GRAM else np.zeros(0, np.int64)


def cover(word: str) -> list[tuple[int, int]]:
    """(gram, offset) that together cover a word of three characters or more."""
    grams = grams_of(word)
    return [(int(grams[k]), k) for k in sorted({*range(0, len(grams), GRAM), len(grams) - 1})]


_ARROW = pa.schema([("gram", pa.int64()), ("field", pa.string()), ("block", pa.string()), ("at", pa.list_(pa.int32())), ("ids", pa.list_(pa.string()))])


def _rows(field: str, ids: list[str], starts: np.ndarray, grams: np.ndarray, counts: np.ndarray, places: np.ndarray) -> list[pa.RecordBatch]:
    """A block's grams, and the row of its texts, by whose first key it is known: keys are unique."""
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(places.astype(np.int32)))
    named = [pa.array([None], pa.int64()), pa.array([field]), pa.array([ids[0]]), pa.array([starts.tolist()], _ARROW.field("at").type), pa.array([ids], _ARROW.field("ids").type)]
    own = [pa.array(grams), pa.array([field] * len(grams), pa.string()), pa.array([ids[0]] * len(grams), pa.string()), lists, pa.nulls(len(grams), _ARROW.field("ids").type)]
    return [pa.RecordBatch.from_arrays(x, schema=_ARROW) for x in (own, named)]


def _block(field: str, ids: list[str], texts: list[str]) -> list[pa.RecordBatch]:
    own = [grams_of(text) for text in texts]
    starts = np.concatenate([[0], np.cumsum([len(x) + GRAM for x in own])])[:-1].astype(np.int64)  # a text's places and one for the gap
    places = np.concatenate([np.arange(first, first + len(x)) for first, x in zip(starts, own, strict=True)])
    grams = np.concatenate(own)
    order = np.argsort(grams, kind="stable")
    keys, first = np.unique(grams[order], return_index=True)
    return _rows(field, ids, starts, keys, np.diff(np.append(first, len(grams))), places[order])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, field, text to the rows of blocks."""
    held: dict[str, tuple[list[str], list[str]]] = {}
    size: dict[str, int] = {}
    for batch in batches:
        for key, field, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if field in held and size[field] + len(text) > BLOCK_CHARS:
                yield from _block(field, *held.pop(field))
            ids, texts = held.setdefault(field, ([], []))
            size[field] = len(text) + (size[field] if ids else 0)
            ids.append(key)
            texts.append(text)
    for field, (ids, texts) in held.items():
        yield from _block(field, ids, texts)


def _kept(rows: pa.Table, live: pa.Table) -> pa.Table:
    """A block without the texts that are hidden. live: id."""
    given, stay = rows.select(_ARROW.names).cast(_ARROW).combine_chunks(), set(live["id"].to_pylist())
    named = given.filter(given["gram"].is_null()).to_pylist()[0]
    keep, starts = np.array([x in stay for x in named["ids"]]), np.array(named["at"])
    if not keep.any():
        return _ARROW.empty_table()
    own = given.filter(given["gram"].is_valid())
    lists = own["at"].combine_chunks()
    places, counts = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
    left = keep[np.searchsorted(starts, places, "right") - 1]
    counts = np.bincount(np.repeat(np.arange(len(counts)), counts)[left], minlength=len(counts))
    ids = [x for x, k in zip(named["ids"], keep, strict=True) if k]
    return pa.Table.from_batches(_rows(named["field"], ids, starts[keep], own["gram"].to_numpy()[counts > 0], counts[counts > 0], places[left]))


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """seg, word, found, at, ids of a block to seg, word and id of the texts in which places were found."""
    for batch in batches:
        for row in range(batch.num_rows):
            seg, word, found, at, ids = (c[row] for c in batch.columns)
            which = np.unique(np.searchsorted(at.values.to_numpy(), found.values.to_numpy(), "right") - 1)
            yield pa.RecordBatch.from_arrays([pa.array([seg.as_py()] * len(which), pa.int32()), pa.array([word.as_py()] * len(which), pa.string()), ids.values.take(pa.array(which)).cast(pa.string())], ["seg", "word", "id"])


def _folder(gram: Column) -> Column:
    return F.coalesce(F.pmod(gram, F.lit(FOLDERS)).cast("int"), F.lit(NAMED))


@dataclass
class SubstringIndex:
    """Segments of grams and of the narrow table of nodes."""

    store: Segments

    @classmethod
    def build(cls, nodes: DataFrame, fields: Sequence[str], folder: str) -> SubstringIndex:
        """nodes: id, label, repo, code and the fields."""
        out = cls(Segments(nodes.sparkSession, "string"))
        out.add(nodes, fields, folder, new=True)
        return out

    def add(self, nodes: DataFrame, fields: Sequence[str], folder: str, new: bool = False) -> None:
        """A segment in a new folder; older rows of the same keys are hidden."""
        nodes = nodes.where("id IS NOT NULL")
        given = nodes.select("id", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.lower(f).alias("text")) for f in fields))).alias("f")).select("id", "f.field", "f.text").where(F.length("text") >= GRAM)
        # Texts are dealt before they are cut, as their grams take many times their room.
        chars = given.agg(F.sum(F.length("text"))).first()[0] or 0
        dealt = given.repartition(max(1, math.ceil(chars / TASK_CHARS)), "id")
        grams = _sorted(dealt.mapInArrow(_cut, _CUT))
        keys = nodes.select("id", "label", "repo", F.col("code").isNotNull().alias("coded"), F.length("code").cast("bigint").alias("size"))
        self.store.write(folder, {"grams": (grams, ["folder"]), "keys": (keys, [])}, None if new else nodes.select(F.col("id").alias("key")))

    def remove(self, ids: DataFrame, folder: str) -> None:
        """A segment that only hides rows. ids: id."""
        empty = {name: (self.store.spark.createDataFrame([], shape), ["folder"] if name == "grams" else []) for name, shape in _SHAPES.items()}
        self.store.write(folder, empty, ids.select(F.col("id").alias("key")))

    def save(self, folder: str) -> SubstringIndex:
        """A copy in a new folder, all segments in one; no text is read."""
        out = SubstringIndex(Segments(self.store.spark, "string"))
        rows = self.store.table("grams", _SHAPES["grams"])
        if any(self.store.hiding):  # places of hidden texts are dropped, block by block
            by = ["seg", "field", "block"]
            live = self.store.live(rows.where(F.col("folder") == NAMED).select(*by, F.explode("ids").alias("id")), "id").toDF("_seg", "_field", "_block", "id")
            rows = rows.drop("folder").groupBy(*by).cogroup(live.groupBy("_seg", "_field", "_block")).applyInArrow(_kept, _CUT)
        # A frequent gram's rows go to several files of its folder.
        dealt = rows.select("gram", "field", "block", "at", "ids").repartition(_folder(F.col("gram")), F.pmod(F.xxhash64("block"), F.lit(8)))
        out.store.write(folder, {"grams": (_sorted(dealt), ["folder"]), "keys": (self.known(), [])})
        return out

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> SubstringIndex:
        return cls(Segments(spark, "string", [folder], [False]))

    def matches(self, words: Sequence[str], fields: Sequence[str]) -> DataFrame:
        """word, id of the nodes that hold a word of three characters or more in any of the fields.

        words: those of one question, lower-cased.
        """
        spark = self.store.spark
        asked = [(w, g, k) for w in dict.fromkeys(words) if len(grams_of(w)) for g, k in cover(w)]
        wanted = spark.createDataFrame([(w, g, k, sum(v == w for v, *_ in asked)) for w, g, k in asked], "word string, gram bigint, offset int, grams int")
        grams = sorted({g for _, g, _ in asked})
        rows, of = self.store.table("grams", _SHAPES["grams"]), F.col("field").isin(*fields)
        held = rows.where(F.col("folder").isin(sorted({g % FOLDERS for g in grams})) & F.col("gram").isin(grams) & of).join(F.broadcast(wanted), "gram")
        # A row per block and word, with the places at which each of the word's grams lets it start.
        starts = F.collect_list(F.transform("at", lambda p: p - F.col("offset"))).alias("starts")
        blocks = held.groupBy("seg", "field", "block", "word", "grams").agg(starts).where(F.size("starts") == F.col("grams"))
        all_ = F.aggregate(F.slice("starts", 2, F.size("starts")), F.element_at("starts", 1), F.array_intersect)
        met, n = Scratch(spark, "met").counted(blocks.select("seg", "field", "block", "word", F.sort_array(all_).alias("found")).where(F.size("found") > 0), "met")
        named = rows.where((F.col("folder") == NAMED) & of).select("seg", "field", "block", "at", "ids")
        hits = named.join(F.broadcast(met) if n <= FEW_BLOCKS else met, ["seg", "field", "block"])
        return self.store.live(hits.select("seg", "word", "found", "at", "ids").mapInArrow(_named, "seg int, word string, id string"), "id").select("word", "id").distinct()

    def known(self) -> DataFrame:
        """id, label, repo, coded, size of the live nodes."""
        return self.store.live(self.store.table("keys", _SHAPES["keys"]), "id").drop("seg")

    def first(self, words: Sequence[str], fields: Sequence[str], n: int, where: str | Column, order: Sequence[Column]) -> list[tuple[str, str]]:
        """(word, id) of the first n nodes of each word in an order over the narrow table; n times the words at most."""
        rows = self.matches(words, fields).join(self.known().where(where), "id")
        rank = F.row_number().over(Window.partitionBy("word").orderBy(*order))
        return [(r["word"], r["id"]) for r in rows.withColumn("_n", rank).where(F.col("_n") <= n).select("word", "id").collect()]


def _sorted(rows: DataFrame) -> DataFrame:
    return rows.withColumn("folder", _folder(F.col("gram"))).sortWithinPartitions("folder", "gram", "block")


def holding(
    rows: DataFrame, fields: Sequence[str], words: DataFrame, word: str, index: SubstringIndex | None = None, n: int | None = None, where: str | Column = "true",
    order: Sequence[Column] | None = None, indexed: Sequence[str] | None = None,
) -> DataFrame:
    """Rows with the words of one question that any of their fields holds, whatever the case.

    With an index (by `id`) only the rows that it names are read, at most n for each word in an
    order over its narrow table if n is given, and the few short words are looked for in all rows.
    `where` is a condition over that table which the rows meet anyway; `indexed` are the names
    that the fields have in the index, if others.
    """
    scanned = lambda few: rows.join(F.broadcast(few), contains_any_ci([F.col(f) for f in fields], F.col(word)))
    if index is None:
        return scanned(words)
    low = {r["_low"] for r in words.select(F.lower(word).alias("_low")).distinct().collect() if r["_low"] is not None}
    long = sorted(w for w in low if len(w) >= GRAM)
    if not long:
        return scanned(words)
    named, spark = words.withColumn("_low", F.lower(word)), rows.sparkSession
    if n is not None:
        found = spark.createDataFrame(index.first(long, indexed or fields, n, where, order or [F.col("id")]), "_low string, id string")
    else:
        found = Scratch(spark, "substrings").put(index.matches(long, indexed or fields).withColumnsRenamed({"word": "_low"}), "found")
    few = found.select("id").distinct().limit(MOST_NAMED + 1).collect()
    hits = rows.where(F.col("id").isin([r["id"] for r in few])).join(F.broadcast(found), "id") if len(few) <= MOST_NAMED else rows.join(found, "id")
    hits = hits.join(F.broadcast(named), "_low").drop("_low")
    return hits.unionByName(scanned(words.where(F.length(F.lower(word)) < GRAM)).select(*hits.columns)) if len(long) < len(low) else hits
