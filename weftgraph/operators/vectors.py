"""An approximate index of vectors: coarse cells, residual codes in files by cell, exact rescoring.

The centroids are fitted on a bounded sample (`FIT_ROWS` rows of at most `FIT_BYTES` bytes,
taken by hash order) and the index holds every row: its cell, an 8-bit code of what is left
of its unit vector after the cell's centroid, and the unit vector itself, in tables whose
folders are segments and cells. A question ranks the centroids, reads the codes of the
nearest cells, and reads the vectors of the best `RESCORE` * k of these to score
them as an exact scan does. How many cells are read is measured at the fit: as many as hold
the share `RECALL` of the sample's own nearest neighbours, few where vectors lie in groups
and most of them where they lie anywhere. Tables of questions meet the cells in an equi join, in blocks
of bounded rows on both sides that are one matrix product each.

A batch of new or changed rows is a segment of its own, coded by the same centroids, that
hides older rows of its keys, so no stored file is written again; `save` folds all
segments into one, and `compact` also fits the centroids anew. What a question costs
besides its cells grows with the rows changed since.

Cases: rows whose vector is null, empty, of length zero or of another size than the first
one's are in no cell and never found; a null key is left out; keys that repeat in a batch
are an error of the caller's; an index of no rows answers with no rows; equal scores are
told apart by key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.operators.segments import Segments

#: The sample that centroids are fitted on, cells at most, rounds of the fit.
FIT_ROWS = 20_000
FIT_BYTES = 64 << 20
MOST_CELLS = 4096
ROUNDS = 10
#: The share of neighbours that a question is to find, neighbours and questions of the sample that this is measured with.
RECALL = 0.98
NEIGHBOURS = 15
TRIALS = 256
#: Candidates rescored for each wanted row.
RESCORE = 4
#: Rows of the blocks of a matrix product: vectors and questions.
BLOCK_ROWS = 8192
QUESTION_ROWS = 512
#: Files that a cell's rows are dealt to.
FILES = 4


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(vector: Column) -> Column:
    """The vector scaled to length 1, in doubles; null for one of length 0, without numbers or null."""
    length = F.sqrt(dot(vector, vector))
    return F.when(length > 0, F.transform(vector, lambda x: x.cast("double") / length))


def scaled(vector: Sequence[float]) -> list[float] | None:
    """The same of a question's vector."""
    length = sum(float(v) ** 2 for v in vector) ** 0.5
    return [float(v) / length for v in vector] if length else None


def fit_centroids(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means over unit vectors; it starts from rows spread evenly over the sample."""
    centroids = sample[np.linspace(0, len(sample) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        cell = (sample @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, cell, sample)
        length = np.linalg.norm(sums, axis=1)
        moved = length > 1e-9  # an empty cell stays where it is
        centroids[moved] = sums[moved] / length[moved, None]
    return centroids.astype(np.float32)


def probes_needed(sample: np.ndarray, centroids: np.ndarray) -> int:
    """Cells that a question reads to meet `RECALL` of the nearest neighbours, measured within the sample."""
    trial = sample[np.linspace(0, len(sample) - 1, min(TRIALS, len(sample))).astype(int)]
    k = min(NEIGHBOURS + 1, len(sample))
    near = np.argpartition(-(trial @ sample.T), k - 1, axis=1)[:, :k]  # each is a neighbour of its own
    cell = (sample @ centroids.T).argmax(axis=1)
    order = np.argsort(-(trial @ centroids.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centroids))[None, :], 1)
    places = np.sort(np.take_along_axis(place, cell[near], 1).ravel())
    return int(places[min(len(places) - 1, int(np.ceil(RECALL * len(places))))]) + 1


def _matrix(units: pa.Array, size: int) -> np.ndarray:
    flat = units.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, size)


def _coder(centroids: np.ndarray):
    """id, unit to cell, id, scale, code, unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_ROWS):
                batch = whole.slice(at, BLOCK_ROWS)
                rows = _matrix(batch.column(1), centroids.shape[1])
                cell = (rows.astype(np.float32) @ centroids.T).argmax(axis=1)
                rest = rows - centroids[cell]
                scale = np.abs(rest).max(axis=1, initial=0) / 127
                code = np.rint(rest / np.where(scale > 0, scale, 1)[:, None]).astype(np.int8)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch.column(0), pa.array(scale.astype(np.float32)), pa.array([c.tobytes() for c in code], pa.binary()), batch.column(1)], ["cell", "id", "scale", "code", "unit"])

    return run


def _ranker(centroids: np.ndarray, question: np.ndarray, most: int):
    """cell, id and approximate score of the best `most` of each task's rows."""
    near = centroids @ question

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = None
        for rows in batches:
            codes = np.frombuffer(b"".join(rows["code"]), np.int8).reshape(len(rows), -1)
            guess = near[rows["cell"].to_numpy()] + rows["scale"].to_numpy() * (codes.astype(np.float32) @ question)
            part = rows[["cell", "id"]].assign(guess=guess.astype(float))
            best = (part if best is None else pd.concat([best, part])).sort_values(["guess", "id"], ascending=[False, True]).head(most)
        if best is not None:
            yield best

    return run


def _block_product(k: int):
    """The k best of a block of vectors for each question of a block."""

    def run(key: tuple, vectors: pd.DataFrame, questions: pd.DataFrame) -> pd.DataFrame:
        if not len(vectors) or not len(questions):
            return pd.DataFrame({"question": [], "id": [], "cosine": []})
        vectors = vectors.sort_values("id")
        score = np.round(np.stack(questions["q"].to_list()) @ np.stack(vectors["unit"].to_list()).T, 9)  # equal vectors score alike in any block
        best = np.argsort(-score, axis=1, kind="stable")[:, :k]
        ids = vectors["id"].to_numpy()
        return pd.DataFrame({"question": np.repeat(questions["question"].to_numpy(), best.shape[1]), "id": ids[best].ravel(), "cosine": np.take_along_axis(score, best, 1).ravel()})

    return run


def _by_cell(rows: DataFrame) -> DataFrame:
    """Dealt so that each cell goes to a few files, in order of the key."""
    return rows.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(FILES))).sortWithinPartitions("cell", "id")


@dataclass
class VectorIndex:
    """Centroids and the cells read for a question, over segments of one table: cell, id, scale, code, unit."""

    centroids: np.ndarray
    probes: int
    store: Segments

    @property
    def spark(self) -> SparkSession:
        return self.store.spark

    @property
    def size(self) -> int:
        return self.centroids.shape[1]

    @property
    def _shape(self) -> str:
        return f"cell int, id {self.store.key}, scale float, code binary, unit array<double>"

    @classmethod
    def build(cls, rows: DataFrame, home: str) -> VectorIndex:
        """rows: id and unit, the vectors scaled to length 1 (null ones are left out). The folder must be new."""
        spark, ids = rows.sparkSession, rows.schema["id"].dataType.simpleString()
        rows = rows.where("id IS NOT NULL AND size(unit) > 0").select("id", "unit")
        order = F.xxhash64("id")
        first = rows.orderBy(order, "id").limit(1).collect()
        size = len(first[0]["unit"]) if first else 1
        rows = rows.where(F.size("unit") == size)
        n = rows.count()
        most = max(256, min(FIT_ROWS, FIT_BYTES // (8 * size)))
        sample = np.array([r["unit"] for r in rows.orderBy(order, "id").limit(most).select("unit").collect()], float).reshape(-1, size)
        cells = int(np.clip(round(n**0.5), 1, min(MOST_CELLS, max(1, len(sample)))))
        centroids = fit_centroids(sample, cells) if n else np.zeros((1, size), np.float32)
        out = cls(centroids, probes_needed(sample, centroids) if n else 1, Segments(spark, ids))
        out.add(rows, home, new=True)
        out._note(home)
        return out

    def _note(self, home: str) -> None:
        """Centroids and numbers, of which there are `MOST_CELLS` rows at most."""
        rows = [(i, self.probes, self.store.key, c.tolist()) for i, c in enumerate(self.centroids)]
        self.spark.createDataFrame(rows, "cell int, probes int, ids string, centroid array<float>").coalesce(1).write.parquet(f"{home}/centroids")

    def add(self, rows: DataFrame, folder: str, new: bool = False) -> None:
        """A segment of new and changed rows (id, unit) in a new folder; a changed row whose unit is null is only hidden."""
        rows = rows.where("id IS NOT NULL").select("id", "unit")
        coded = rows.where(F.size("unit") == self.size).mapInArrow(_coder(self.centroids), self._shape)
        self.store.write(folder, {"cells": (_by_cell(coded), ["cell"])}, None if new else rows.select(F.col("id").alias("key")))

    @classmethod
    def load(cls, spark: SparkSession, home: str) -> VectorIndex:
        rows = spark.read.parquet(f"{home}/centroids").orderBy("cell").collect()
        return cls(np.array([r["centroid"] for r in rows], np.float32), rows[0]["probes"], Segments(spark, rows[0]["ids"], [home], [False]))

    def save(self, home: str) -> VectorIndex:
        """A copy in a new folder, all segments in one."""
        out = VectorIndex(self.centroids, self.probes, Segments(self.spark, self.store.key))
        out.store.write(home, {"cells": (_by_cell(self.cells()), ["cell"])})
        out._note(home)
        return out

    def compact(self, home: str) -> VectorIndex:
        """A new index of the live rows, its centroids fitted anew."""
        return VectorIndex.build(self.cells().select("id", "unit"), home)

    def cells(self, only: Sequence[int] | None = None) -> DataFrame:
        """The live rows: cell, id, scale, code, unit; of the cells named only, whose folders alone are read."""
        rows = self.store.table("cells", self._shape)
        rows = rows if only is None else rows.where(F.col("cell").isin(*map(int, only)))
        return self.store.live(rows, "id").drop("seg")

    def top_k(self, vector: Sequence[float], k: int, probes: int | None = None, exact: bool = False, key: str = "id") -> DataFrame:
        """`key` and score, (1 + cosine) / 2, of the k nearest rows found, best first; `exact` scans all rows."""
        asked = scaled(vector)
        if asked is None or len(asked) != self.size:
            return self.spark.createDataFrame([], f"{key} {self.store.key}, score double")
        if exact:
            found = self.cells()
        else:
            question = np.array(asked, np.float32)
            near = np.argsort(-(self.centroids @ question), kind="stable")[: probes or self.probes]
            ranked = self.cells(near.tolist()).select("cell", "id", "scale", "code").mapInPandas(_ranker(self.centroids, question, RESCORE * k), f"cell int, id {self.store.key}, guess double")
            best = ranked.orderBy(F.desc("guess"), "id").limit(RESCORE * k).collect()
            found = self.cells(sorted({r["cell"] for r in best})).where(F.col("id").isin([r["id"] for r in best]))
        # Vector by vector in the engine's own arithmetic, so that exact and approximate scores are equal.
        score = (1 + dot(F.col("unit"), F.array(*map(F.lit, asked)))) / 2
        return found.select(F.col("id").alias(key), score.alias("score")).orderBy(F.desc("score"), key).limit(k)

    def nearest(self, questions: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """question, rank, id, score of the k nearest rows found for each question. questions: question (a key), unit.

        A question meets the cells that it probes; with as many probes as there are cells the answer is exact.
        """
        # Numbers per cell, of which there are `MOST_CELLS` at most, tell the parts into which its rows and questions are dealt.
        asked = questions.where((F.size("unit") == self.size) & F.col("question").isNotNull()).select("question", "unit")
        aimed = asked.mapInArrow(_aimer(self.centroids, min(len(self.centroids), probes or self.probes)), f"question {asked.schema['question'].dataType.simpleString()}, q array<double>, cell int")
        live = self.cells()
        parts = live.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("parts"))
        lots = aimed.groupBy("cell").agg(F.ceil(F.count("*") / QUESTION_ROWS).cast("int").alias("lots"))
        plan = F.broadcast(parts.join(lots, "cell"))
        spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        rows = live.join(plan, "cell").select("cell", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), spread(F.col("lots")).alias("lot"), "id", "unit")
        lot = aimed.join(plan, "cell").select("cell", spread(F.col("parts")).alias("part"), F.pmod(F.xxhash64("question"), "lots").cast("int").alias("lot"), "question", "q")
        by = ("cell", "part", "lot")
        shape = f"question {asked.schema['question'].dataType.simpleString()}, id {self.store.key}, cosine double"
        near = rows.groupBy(*by).cogroup(lot.groupBy(*by)).applyInPandas(_block_product(k), shape)
        rank = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("cosine"), "id"))
        return near.withColumn("rank", rank).where(F.col("rank") <= k).select("question", "rank", "id", ((1 + F.col("cosine")) / 2).alias("score"))


def _aimer(centroids: np.ndarray, probes: int):
    """A row per question and cell that it probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, 65536 // probes)
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                rows = _matrix(batch.column(1), centroids.shape[1])
                cell = np.argsort(-(rows.astype(np.float32) @ centroids.T), axis=1, kind="stable")[:, :probes]
                take = pa.array(np.repeat(np.arange(len(rows)), cell.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(cell.ravel().astype(np.int32))], ["question", "q", "cell"])

    return run
