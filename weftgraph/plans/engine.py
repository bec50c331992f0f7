"""The engine's surface: health, statistics, repositories, checks, questions and ingest."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from weftgraph import schema as X
from weftgraph.graph import FOUND, Graph
from weftgraph.plans import ingest, retrieve
from weftgraph.plans.adjacency import BUCKETS, Adjacency
from weftgraph.plans.materialize import Scratch, together
from weftgraph.sources import readers


class Engine:
    """A graph and the calls that a service makes of it."""

    def __init__(self, spark: SparkSession, graph: Graph | None = None, path: str | None = None, buckets: int = BUCKETS) -> None:
        self.spark = spark
        self.buckets = buckets
        self.path = path
        self._corpus: retrieve.Corpus | None = None
        self.graph = graph or (Graph.load(spark, path) if path and readers.exists(spark, path) else Graph(spark))

    def health(self) -> dict:
        return {"status": "ok"}

    def stats(self) -> dict:
        """All counters; zeros for an empty graph."""
        if not self.graph.nodes:
            return dict.fromkeys(("nodes", "edges", "functions", "files", "commits", "issues", "users", "repositories"), 0)
        return self.graph.stats().first().asDict()

    def repos(self) -> list[str]:
        return [r["full_name"] for r in self.graph.repos().collect()]

    def check(self) -> bool:
        """Whether the stored graph can be reached."""
        return self.path is None or readers.exists(self.spark, self.path)

    def corpus(self) -> retrieve.Corpus:
        """What questions are asked of, prepared with the first one and kept until the graph changes.

        Nodes and edges are bucketed by their keys, commits (with their repository) stand in the order of theirs, so that a
        question that names some reads the files that hold them.
        """
        if self._corpus is None:
            g, scratch = self.graph, Scratch(self.spark, "corpus")
            bare = lambda c: F.expr(f"substring({c}, instr({c}, '::') + 2)")
            repo = g.edge("BELONGS_TO").select(bare("src").alias("sha"), bare("dst").alias("repo"))
            put = lambda rows, key, name: scratch.put(rows.repartitionByRange(key).sortWithinPartitions(key), name)
            found = [x for x in FOUND if x in g.nodes]
            near, *rest = together(
                self.spark,
                [
                    lambda: Adjacency.build(g.node_view(*(found or ["File"])), g.edge_view("CALLS", "DEPENDS_ON"), self.buckets),
                    lambda: put(g.label("Commit").join(repo, "sha", "left"), "sha", "commits"),
                    lambda: scratch.put(g.edge("AUTHORED").select(bare("src").alias("src"), bare("dst").alias("dst")), "authored"),
                    lambda: scratch.put(g.edge("MODIFIED").select(bare("src").alias("src"), "dst"), "changes"),
                    lambda: g.index_texts() if "Commit" in g.nodes else None,
                    lambda: g.index_vectors() if "Function" in g.nodes else None,
                    lambda: g.index_grams() if found else None,
                    lambda: g.index_grams("Commit") if "Commit" in g.nodes else None,
                ],
            )
            self._corpus = retrieve.Corpus(near.nodes, near, *rest)
        return self._corpus

    def retrieve(self, question: str, repos: Sequence[str] | None = None, top_k: int = X.TOP_K) -> str:
        """The context of a question."""
        return retrieve.assemble(retrieve.retrieve_rows(self.corpus(), question, repos, top_k)).first()["context"]

    def chat(self, question: str, repos: Sequence[str] | None = None, top_k: int = X.TOP_K, model: Callable[[str], str] | None = None) -> dict:
        return retrieve.answer(self.retrieve(question, repos, top_k), question, model)

    def bootstrap(self, repo: str, inputs: Sequence[str], **options) -> dict[str, int]:
        """Ingests a repository from folders of JSON lines (tree, contents, commit list, commit details, and the recent commits' files if there is a fifth); the run's counters."""
        self._corpus = None
        return ingest.bootstrap(self.graph, repo, **ingest.load_repos(inputs, self.graph), **options)

    def fetch(self, repo: str, fetch: readers.Fetch, most: int = 200, **options) -> dict[str, int]:
        """The same from a hosting service's answers; what is stored already is not fetched again."""
        self._corpus = None
        return ingest.bootstrap(self.graph, repo, **ingest.fetch_repo(self.graph, repo, fetch, most, force=options.get("force", False), as_of=options.get("as_of")), most=most, **options)

    def save(self, path: str) -> None:
        self.graph.save(path)
        self._corpus = None  # the indexes are read from the snapshot from now on


#: Engines that are kept open at once.
OPEN_ENGINES = 16
_OPEN: OrderedDict[tuple[str, str], Engine] = OrderedDict()


def engine_at(spark: SparkSession, path: str) -> Engine:
    """The engine of a stored graph, opened once; the one that was asked longest ago is closed for a new one."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _OPEN:
        _OPEN[key] = Engine(spark, path=path)
        if len(_OPEN) > OPEN_ENGINES:
            _OPEN.popitem(last=False)
    _OPEN.move_to_end(key)
    return _OPEN[key]
