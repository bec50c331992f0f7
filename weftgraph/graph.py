"""The graph as tables: one DataFrame per node label and one per edge type, with union views."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph import schema as X
from weftgraph.operators.search import TextIndex
from weftgraph.operators.segments import exists
from weftgraph.operators.substrings import SubstringIndex
from weftgraph.operators.vectors import VectorIndex
from weftgraph.plans.materialize import Scratch, together

VIEW = ("id", "label", "name", "path", "full_name", "filepath", "repo", "code")
#: Labels that questions look for by substrings, and the fields of theirs that are indexed.
FOUND = ("File", "Function", "Module")
FOUND_BY = ("name", "path", "full_name", "filepath", "code")


def node_id(label: str) -> F.Column:
    """The label and key of a node as one text."""
    return F.concat_ws("::", F.lit(label), *X.KEYS[label])


def commit_text() -> F.Column:
    """What a ranked search reads of a commit."""
    return F.concat_ws(" ", "summary_text", "message", "diff_text")


def as_shas(commits: DataFrame) -> DataFrame:
    """Commits as rows of a substring index."""
    return commits.select(F.col("sha").alias("id"), F.lit("Commit").alias("label"), F.lit(None).cast("string").alias("repo"), F.lit(None).cast("string").alias("code"), "sha")


@dataclass
class Graph:
    spark: SparkSession
    nodes: dict[str, DataFrame] = field(default_factory=dict)
    edges: dict[str, DataFrame] = field(default_factory=dict)
    texts: dict[str, TextIndex] = field(default_factory=dict)
    vectors: dict[str, VectorIndex] = field(default_factory=dict)
    grams: dict[str, SubstringIndex] = field(default_factory=dict)
    #: Keys that were written since the indexes were brought up to date, by label.
    written: dict[str, list[DataFrame]] = field(default_factory=dict)
    #: Rows of the tables that were counted as they were written.
    sizes: dict[str, int] = field(default_factory=dict)

    def size(self, name: str, rows: DataFrame | None) -> int:
        """Rows of a table: as its write counted them, else from its files, once."""
        if rows is None:
            return 0
        if name not in self.sizes:
            self.sizes[name] = rows.count()
        return self.sizes[name]

    def label(self, name: str) -> DataFrame:
        return self.nodes.get(name) if name in self.nodes else self.spark.createDataFrame([], X.NODES[name])

    def edge(self, kind: str) -> DataFrame:
        """src, type, dst and the temporal properties (null for edges that have none)."""
        if kind not in self.edges:
            return self.spark.createDataFrame([], X.EDGE)
        rows = self.edges[kind]
        given = {f.name: F.col(f.name) if f.name in rows.columns else F.lit(None) for f in X.EDGE} | {"type": F.lit(kind)}
        return rows.select(*(given[f.name].cast(f.dataType).alias(f.name) for f in X.EDGE))

    def node_view(self, *labels: str) -> DataFrame:
        """All nodes of the labels (all labels if none is named) with the properties that traversals read."""
        parts = []
        for name in labels or list(self.nodes):
            rows = self.label(name)
            have = set(rows.columns)
            key = F.col("node_id") if "node_id" in have else node_id(name)
            pick = {c: F.col(c) if c in have and c != "id" else F.lit(None) for c in VIEW} | {"id": key, "label": F.lit(name)}
            parts.append(rows.select(*(pick[c].cast("string").alias(c) for c in VIEW)))
        return reduce(DataFrame.unionByName, parts)

    def edge_view(self, *kinds: str) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.edge(k) for k in kinds or self.edges])

    def stats(self) -> DataFrame:
        """All counters in one pass over each table: nodes, edges and six labels."""
        nodes = self.node_view().groupBy("label").agg(F.count("*").alias("n"))
        edges = self.edge_view().select("type").groupBy("type").agg(F.count("*").alias("n"))
        of = lambda label: F.coalesce(F.sum(F.when(F.col("what") == label, F.col("n"))), F.lit(0)).alias(label.lower() + "s")
        both = nodes.select(F.lit("node").alias("kind"), F.col("label").alias("what"), "n").unionByName(edges.select(F.lit("edge").alias("kind"), F.col("type").alias("what"), "n"))
        total = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0)).alias(kind + "s")
        repositories = F.coalesce(F.sum(F.when(F.col("what") == "Repository", F.col("n"))), F.lit(0)).alias("repositories")
        return both.agg(total("node"), total("edge"), of("Function"), of("File"), of("Commit"), of("Issue"), of("User"), repositories)

    def repos(self) -> DataFrame:
        return self.label("Repository").where("full_name <> ''").select("full_name").orderBy("full_name")

    def _folder(self, name: str) -> str:
        return f"{Scratch(self.spark, 'index').home}/{name}"

    def index_texts(self) -> TextIndex:
        """The text index of the commits: written when it is first asked for, stored with the graph, and kept up by `follow`."""
        if "Commit" not in self.texts:
            self.texts["Commit"] = TextIndex.build(self.label("Commit"), "sha", commit_text(), self._folder("texts"))
        return self.texts["Commit"]

    def index_vectors(self, label: str = "Function") -> VectorIndex:
        """The vectors of the functions or modules, by node id; made and kept likewise."""
        if label not in self.vectors:
            self.vectors[label] = VectorIndex.build(self._units(self.label(label), label), self._folder("vectors"))
        return self.vectors[label]

    def index_grams(self, name: str = "Node") -> SubstringIndex:
        """The substrings of files, functions and modules by node id ("Node"), or of commits' shas by sha ("Commit")."""
        if name not in self.grams:
            rows, fields = (self.node_view(*FOUND), FOUND_BY) if name == "Node" else (as_shas(self.label("Commit")), ("sha",))
            self.grams[name] = SubstringIndex.build(rows, fields, self._folder("grams"))
        return self.grams[name]

    def _units(self, rows: DataFrame, label: str) -> DataFrame:
        return rows.select(node_id(label).alias("id"), "unit")

    def follow(self, label: str, keys: DataFrame, before: DataFrame | None) -> None:
        """Brings the indexes that exist up to date with a label's table after a batch. keys: those that the batch wrote."""
        of = lambda rows: rows.join(keys.distinct(), X.KEYS[label], "left_semi")
        if label == "Commit" and "Commit" in self.texts:
            self.texts["Commit"].add(of(self.label(label)), commit_text(), self._folder("texts"), None if before is None else of(before))
            self.texts = {k: v.save(self._folder("texts")) if v.store.many else v for k, v in self.texts.items()}
        # Properties that the others read are set by a node's first write.
        fresh = of(self.label(label)) if before is None else of(self.label(label)).join(before.select(X.KEYS[label]), X.KEYS[label], "left_anti")
        if label in self.vectors:
            self.vectors[label].add(self._units(fresh, label), self._folder("vectors"))
            self.vectors[label] = self.vectors[label].save(self._folder("vectors")) if self.vectors[label].store.many else self.vectors[label]
        name = "Commit" if label == "Commit" else "Node" if label in FOUND else None
        if name in self.grams:
            rows = as_shas(fresh) if label == "Commit" else Graph(self.spark, {label: fresh}).node_view(label)
            self.grams[name].add(rows, ("sha",) if label == "Commit" else FOUND_BY, self._folder("grams"))
            self.grams[name] = self.grams[name].save(self._folder("grams")) if self.grams[name].store.many else self.grams[name]

    def forget(self, label: str, gone: DataFrame) -> None:
        """Hides deleted nodes of a label from its indexes."""
        ids = gone.select(node_id(label).alias("id"))
        if label in self.vectors:
            self.vectors[label].add(ids.withColumn("unit", F.lit(None).cast("array<double>")), self._folder("vectors"))
        if label in FOUND and "Node" in self.grams:
            self.grams["Node"].remove(ids, self._folder("grams"))

    def save(self, path: str) -> None:
        """Writes a snapshot: a table per label and edge type, and the indexes, each as one segment. The path must be new."""
        indexes = [(self.grams, "Node", self.index_grams, f"{path}/grams/Node")] if any(x in self.nodes for x in FOUND) else []
        if "Commit" in self.nodes:
            indexes += [(self.texts, "Commit", self.index_texts, f"{path}/texts/Commit"), (self.grams, "Commit", partial(self.index_grams, "Commit"), f"{path}/grams/Commit")]
        indexes += [(self.vectors, x, partial(self.index_vectors, x), f"{path}/vectors/{x}") for x in ("Function", "Module") if x in self.nodes]
        # Each job has an index or a table of its own.
        tables = [partial(rows.write.parquet, f"{path}/{group}/{name}") for group, box in (("nodes", self.nodes), ("edges", self.edges)) for name, rows in box.items()]
        saved = together(self.spark, [lambda get=get, to=to: get().save(to) for _, _, get, to in indexes] + tables)
        for (box, name, _, _), index in zip(indexes, saved, strict=False):
            box[name] = index

    @classmethod
    def load(cls, spark: SparkSession, path: str, labels: tuple[str, ...] = tuple(X.NODES), kinds: tuple[str, ...] = X.EDGE_TYPES) -> Graph:
        """Reads the tables of a snapshot that exist."""
        out = cls(spark)
        for group, names, box in (("nodes", labels, out.nodes), ("edges", kinds, out.edges)):
            for name in names:
                if exists(spark, f"{path}/{group}/{name}"):
                    box[name] = spark.read.parquet(f"{path}/{group}/{name}")
        if exists(spark, f"{path}/texts/Commit/totals"):
            out.texts["Commit"] = TextIndex.load(spark, f"{path}/texts/Commit", "sha")
        for label in ("Function", "Module"):
            if exists(spark, f"{path}/vectors/{label}/centroids"):
                out.vectors[label] = VectorIndex.load(spark, f"{path}/vectors/{label}")
        for name in ("Node", "Commit"):
            if exists(spark, f"{path}/grams/{name}/keys"):
                out.grams[name] = SubstringIndex.load(spark, f"{path}/grams/{name}")
        return out
