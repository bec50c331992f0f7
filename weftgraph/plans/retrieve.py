"""Hybrid retrieval: a question is routed, each stage that it needs returns rows, the rows become one text.

The question is one row on the driver; its signals decide which stages are
planned. Stages are lazy frames of one row shape.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph import schema as X
from weftgraph.functions import render, router
from weftgraph.operators import search, traverse
from weftgraph.operators.filters import in_repos, with_repo_hint
from weftgraph.operators.substrings import SubstringIndex, holding
from weftgraph.operators.vectors import VectorIndex
from weftgraph.plans.adjacency import Adjacency, Changes, Edges
from weftgraph.plans.materialize import Scratch
from weftgraph.sources.readers import hash_vector

# What is said where nothing is found, and the names of the stages.
NOTHING = "No relevant context found in the knowledge graph."
STAGES = ("dependency-impact", "vector-search", "path-hint-boost", "recent-commits", "fulltext-commits", "commit-file-lookup", "blame-traversal")


@dataclass
class Corpus:
    """What a question is asked of.

    nodes: id, label, name, path, full_name, filepath, repo, code, and embedding and unit
    where there is no index of them; edges: src, type, dst, is_active, or stored adjacency, or made where asked; commits: sha,
    timestamp, message, summary_text, diff_text, repo; authored: login to sha; changes:
    sha to node id, or made where asked; then the stored indexes, if there are any: texts of the commits, vectors
    of the functions, substrings of the nodes and of the commits' shas.
    """

    nodes: DataFrame
    edges: DataFrame | Adjacency | Edges
    commits: DataFrame
    authored: DataFrame
    changes: DataFrame | Changes
    texts: search.TextIndex | None = None
    vectors: VectorIndex | search.Vectors | None = None
    grams: SubstringIndex | None = None
    shas: SubstringIndex | None = None


def _rows(df: DataFrame, stage: int, order: Sequence[Column]) -> DataFrame:
    """The common row shape, numbered within the stage in a total order. A stage returns tens of rows."""
    given = df.withColumn("ord", F.row_number().over(Window.partitionBy(F.lit(stage)).orderBy(*order)).cast("long"))
    have = set(given.columns) | {"stage", "source"}
    pick = {f.name: F.col(f.name) if f.name in have else F.lit(None) for f in X.RETRIEVED} | {"stage": F.lit(stage), "source": F.lit(STAGES[stage])}
    return given.select(*(pick[f.name].cast(f.dataType).alias(f.name) for f in X.RETRIEVED))


def signals_of(spark: SparkSession, question: str) -> Row:
    return router.signals(spark.createDataFrame([(question,)], "query string")).first()


def _words(spark: SparkSession, values: Sequence[str], name: str) -> DataFrame:
    return spark.createDataFrame([(n, v) for n, v in enumerate(values)], f"pos int, {name} string")


def impact_stage(c: Corpus, s: Row, repos: Sequence[str] | None) -> DataFrame:
    spark = c.nodes.sparkSession
    walk = traverse.impact(c.nodes, c.edges, _words(spark, s["subjects"], "subject"), repos, grams=c.grams)
    rows = walk.withColumn("group", F.lit(1))
    primary = next((x for x in s["subjects"] if len(x) > 4), s["subjects"][0])
    rows = traverse.subject_definition(c.nodes, primary, repos, c.grams).withColumn("group", F.lit(0)).unionByName(rows, allowMissingColumns=True)
    hints = F.array(*map(F.lit, s["repo_hints"])) if s["repo_hints"] and not repos else F.array().cast("array<string>")
    rows = with_repo_hint(rows, hints)
    if s["field_hints"]:
        grep = traverse.field_grep(c.nodes.where("label = 'Function'"), _words(spark, s["field_hints"], "field"), repos, grams=c.grams)
        grep = grep.withColumns({"code": render.mark_hit_lines(F.col("code"), F.col("field")), "filepath": F.coalesce("filepath", "path", F.lit("")), "repo": F.coalesce("repo", F.lit("")), "group": F.lit(2), "ord_pos": F.col("pos"), "ord_id": F.col("id")})
        rows = rows.unionByName(with_repo_hint(grep, hints).select("name", "filepath", "repo", "rel_type", "code", "group", "ord_pos", "ord_id"), allowMissingColumns=True)
    return _rows(rows, 0, [F.col(x) for x in ("group", "ord_pos", "ord_seed", "ord_kind", "rel_type", "ord_id")])


def vector_stage(c: Corpus, vector: Sequence[float], k: int, repos: Sequence[str] | None) -> DataFrame:
    hits = search.vector_search(c.nodes, c.edges, vector, k, repos, index=c.vectors)
    return _rows(hits.withColumn("filepath", F.coalesce("filepath", "path")), 1, [F.desc("score"), F.col("id")])


def path_stage(c: Corpus, hints: Sequence[str], repos: Sequence[str] | None) -> DataFrame:
    boosted = traverse.path_boost(c.nodes.where("label = 'Function'"), _words(c.nodes.sparkSession, hints, "hint"), repos, grams=c.grams)
    return _rows(boosted, 2, [F.col("pos"), F.col("id")])


def recency_stage(c: Corpus, s: Row, repos: Sequence[str] | None) -> DataFrame:
    named = [s["repo_hint"]] if s["repo_hint"] else repos
    return _rows(traverse.recent_commits(c.commits, s["commit_limit"], named), 3, [F.desc_nulls_first("timestamp"), F.col("name")])


def fulltext_hits(c: Corpus, s: Row) -> DataFrame:
    text = F.concat_ws(" ", "summary_text", "message", "diff_text")
    found = c.texts.ask(s["search_terms"]) if c.texts else search.search(c.commits, "sha", text, s["search_terms"])
    return found.join(c.commits.select("sha", F.coalesce("summary_text", "message", "diff_text", F.lit("")).alias("code")), "sha")


def fulltext_stage(hits: DataFrame) -> DataFrame:
    return _rows(hits.select(F.col("sha").alias("name"), F.lit("").alias("filepath"), "code", "score"), 4, [F.desc("score"), F.col("name")])


def commit_files_stage(c: Corpus, shas: Sequence[str], repos: Sequence[str] | None) -> DataFrame:
    hints = _words(c.nodes.sparkSession, shas, "hint")
    plain = hints.drop("pos")
    meta = traverse.commit_meta(c.commits, c.authored, plain, grams=c.shas).withColumns({"filepath": F.col("repo"), "rel_type": F.lit(""), "kind": F.lit(0)})
    parts = [meta]
    for kind, label in ((1, "File"), (2, "Function")):
        targets = c.nodes.where(F.col("label") == label).select("id", F.coalesce("name", "path").alias("name"), F.coalesce("filepath", "path").alias("filepath"), "code", "label")
        parts.append(traverse.commit_targets(c.commits, c.changes, targets, plain, repos, grams=c.shas).withColumn("kind", F.lit(kind)))
    rows = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True).join(F.broadcast(hints), "hint")
    return _rows(rows, 5, [F.col(x) for x in ("pos", "kind", "filepath", "name", "commit_sha")])


def _targets(c: Corpus, label: str) -> DataFrame:
    return c.nodes.where(F.col("label") == label).select(F.col("id").alias("target"), F.coalesce("filepath", "path").alias("filepath"), (F.col("name") if label == "Function" else F.lit("")).alias("func_name"))


def _changes_of(c: Corpus, repos: Sequence[str] | None, targets: DataFrame) -> DataFrame:
    """Changes of the targets that a question names: written at each step, so that where they are few all others stay where they are."""
    scratch = Scratch(c.nodes.sparkSession, "blame")
    named = scratch.put(targets, "targets")
    asked = c.changes.of_nodes(named.select(F.col("target").alias("id"))) if isinstance(c.changes, Changes) else c.changes
    changes = scratch.put(asked.join(named.select(F.col("target").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"), "changes")
    shas = changes.select("src").distinct()
    commits = in_repos(c.commits, repos).join(shas.withColumnRenamed("src", "sha"), "sha", "left_semi")
    authored = c.authored.join(shas.withColumnRenamed("src", "dst"), "dst", "left_semi")
    return traverse.authored_changes(authored, commits, changes).join(named, "target")


def blame_stage(c: Corpus, s: Row, paths: Sequence[str], repos: Sequence[str] | None) -> DataFrame:
    """By the paths of the vector stage; without any by the question's hints; without these the top authors."""
    spark = c.nodes.sparkSession
    hints = [*s["func_hints"], *s["file_hints"]]
    if paths:
        named = F.broadcast(_words(spark, paths, "filepath"))
        parts = [traverse.latest(_changes_of(c, repos, _targets(c, label).join(named, "filepath")), ["filepath"]).withColumn("kind", F.lit(k)) for k, label in enumerate(("File", "Function"))]
        rows = parts[0].unionByName(parts[1])
    elif hints:
        held = holding(_targets(c, "File").withColumn("id", F.col("target")), ["filepath"], _words(spark, hints, "hint"), "hint", c.grams, indexed=["path"]).drop("id")
        rows = traverse.latest(_changes_of(c, repos, held), ["hint"]).withColumn("kind", F.lit(0))
    else:
        authored = c.authored.join(in_repos(c.commits, repos).select(F.col("sha").alias("dst")), "dst", "left_semi") if repos else c.authored
        top = traverse.top_authors(authored)
        rows = top.select("author", F.concat(F.col("commit_count").cast("string"), F.lit(" commits total")).alias("commit_sha"), F.lit("").alias("commit_msg"), F.lit("").alias("committed_at"), F.lit("").alias("func_name"), F.lit("(all files)").alias("filepath"), (-F.col("commit_count")).alias("pos"), F.lit(0).alias("kind"))
        return _rows(rows, 6, [F.col("pos"), F.col("author")])
    return _rows(rows, 6, [F.col("pos"), F.col("kind"), F.desc_nulls_first("committed_at"), F.col("commit_sha"), F.col("func_name")])


def _held(rows: DataFrame) -> DataFrame:
    """A stage's rows, of which its limits leave few, on the driver: read again without running the stage again."""
    return rows.sparkSession.createDataFrame(rows.collect(), rows.schema)


def retrieve_rows(c: Corpus, question: str, repos: Sequence[str] | None = None, top_k: int = X.TOP_K, vector: Sequence[float] | None = None) -> DataFrame:
    """The rows of every stage that the question needs, in stage order. `vector`: of the question; [] for none."""
    spark = c.nodes.sparkSession
    s = signals_of(spark, question)
    vector = hash_vector(question) if vector is None else vector
    parts: list[DataFrame] = []
    paths: list[str] = []
    found = False
    if s["impact"] and s["subjects"]:
        parts.append(_held(impact_stage(c, s, repos)))
        found = not parts[-1].isEmpty()
    if len(vector):
        hits = _held(vector_stage(c, vector, top_k, repos))
        paths = list(dict.fromkeys(r["filepath"] for r in hits.select("filepath").collect() if r["filepath"]))  # top_k rows
        parts.append(hits)
        found = found or bool(paths)
    if s["path_hints"]:
        parts.append(_held(path_stage(c, s["path_hints"], repos)))
        found = found or not parts[-1].isEmpty()
    hits = None
    if s["commit_gate"] or not found:
        if s["recency"]:
            parts.append(recency_stage(c, s, repos))
        hits = fulltext_hits(c, s)
        parts.append(fulltext_stage(hits))
    if s["shas"] or s["commit_files"]:
        shas = s["shas"] or [r["sha"][:12] for r in (hits or fulltext_hits(c, s)).orderBy(F.desc("score"), "sha").limit(3).collect()]
        if shas:
            parts.append(commit_files_stage(c, shas, repos))
    if s["blame"]:
        parts.append(blame_stage(c, s, paths, repos))
    out = spark.createDataFrame([], X.RETRIEVED)
    for part in parts:
        out = out.unionByName(part)
    return out


def assemble(rows: DataFrame) -> DataFrame:
    """One row: the blocks of all stages in order, parted by blank lines."""
    plain = render.context_block(rows.where("stage < 6"), ["stage"], allow_no_code=F.col("stage").isin(0, 5))
    blocks = plain.unionByName(render.blame_block(rows.where("stage = 6"), ["stage"]))
    ordered = F.array_sort(F.collect_list(F.struct("stage", "block")))
    text = F.array_join(F.transform(ordered, lambda b: b["block"]), "\n\n")
    tags = F.array_join(F.transform(ordered, lambda b: F.get(F.array(*map(F.lit, STAGES)), b["stage"])), "+")
    return blocks.agg(text.alias("t"), tags.alias("g")).select(F.coalesce(F.nullif("t", F.lit("")), F.lit(NOTHING)).alias("context"), F.coalesce(F.nullif("g", F.lit("")), F.lit("none")).alias("path"))


PROMPT = "You answer questions about a code base from the context below, whose sections start with a [Source: ...] tag. Say so if the context doesn't hold the answer.\n\nCONTEXT:\n{context}\n\nQUESTION: {question}\n"


def answer(context: str, question: str, model: Callable[[str], str] | None = None) -> dict:
    """What a text model says to the prompt; without one, the context. An error becomes the answer."""
    prompt = PROMPT.format(context=context, question=question)
    try:
        text = model(prompt) if model else context
    except Exception as e:  # noqa: BLE001  any failure of the outside model is told, not raised
        text = f"Error: {e}"
    return {"answer": text, "usage": {"prompt_chars": len(prompt), "answer_chars": len(text)}}
