"""Bootstrap of a graph from a file tree, contents and commits, in three phases of set-based steps.

Each phase turns its inputs into node and edge batches with an order, and folds them
onto what is stored. What a phase reads more than once (parsed sources, commits, diffs)
and the tables that it changes are written before the next one, so a source is parsed,
embedded and fetched once. Nothing loops over rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime, timezone
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph import schema as X
from weftgraph.functions import imports, patches, syntax
from weftgraph.functions.paths import function_id, is_entry_point, is_noise, is_source, is_utility_dir, parent_of
from weftgraph.graph import Graph
from weftgraph.operators import traverse, upsert, vectors
from weftgraph.plans.materialize import Scratch, together
from weftgraph.sources import host, readers

INITIAL = "initial_scan"


def _path_id(label: str, path: str = "path") -> Column:
    return F.concat_ws("::", F.lit(label), path, "repo")


def _merge(graph: Graph, label: str, batch: DataFrame) -> None:
    columns = {f.name: F.col(f.name) if f.name in batch.columns else F.lit(None) for f in X.NODES[label]}
    typed = batch.select(*(columns[f.name].cast(f.dataType).alias(f.name) for f in X.NODES[label]), F.col("seq"))
    graph.nodes[label] = upsert.upsert_label(label, graph.nodes.get(label), typed)
    graph.written.setdefault(label, []).append(typed.select(X.KEYS[label]))


def _link(graph: Graph, kind: str, rows: DataFrame) -> None:
    """Adds edges (src, dst)."""
    graph.edges[kind] = upsert.merge_edges(graph.edges.get(kind), rows.select("src", F.lit(kind).alias("type"), "dst"))


def settle(graph: Graph, scratch: Scratch, before: dict[str, DataFrame]) -> dict[str, int]:
    """Writes the tables that changed since `before`, a copy of nodes and edges by name, and brings the indexes up to date.

    Returns the nodes and relationships that the writes created, which the writes count themselves.
    """
    made, grown = {"nodes_created": 0, "relationships_created": 0}, set()
    changed = [(box, what, name) for box, what in ((graph.nodes, "nodes_created"), (graph.edges, "relationships_created")) for name, rows in box.items() if before.get(name) is not rows]
    known = together(graph.spark, [partial(graph.size, name, before.get(name)) for _, _, name in changed])
    tables = together(graph.spark, [partial(scratch.counted, box[name], name) for box, _, name in changed])
    for (box, what, name), old, (rows, size) in zip(changed, known, tables, strict=True):
        box[name], graph.sizes[name] = rows, size
        made[what] += max(0, size - old)
        grown |= {name} if size > old else set()
    for label, keys in graph.written.items():
        # What the indexes read of other labels than commits never changes once it is there.
        if label in grown or (label == "Commit" and not reduce(DataFrame.unionByName, keys).isEmpty()):
            graph.follow(label, reduce(DataFrame.unionByName, keys), before.get(label))
    graph.written.clear()
    return made


def _tables(graph: Graph) -> dict[str, DataFrame]:
    return graph.nodes | graph.edges


def set_status(graph: Graph, repo: str, status: str, detail: str = "", commits: int = 0, scanned: int = 0, at: str | None = None) -> None:
    """The progress record of a repository; the last one stays."""
    row = graph.spark.createDataFrame([(repo, status, detail, commits, scanned, at)], X.NODES["BootstrapStatus"])
    _merge(graph, "BootstrapStatus", row.withColumn("seq", F.lit(0)))


def scan_tree(graph: Graph, tree: DataFrame) -> DataFrame:
    """Phase 1: directories and files without noise, with their containment. Returns the source files.

    tree: repo, pos, path, type (tree or blob).
    """
    kept = tree.where(~is_noise(F.col("path"))).withColumn("seq", F.col("pos"))
    dirs = kept.where("type = 'tree'").withColumn("utility", is_utility_dir(F.col("path")))
    files = kept.where("type = 'blob'").withColumn("entry_point", is_entry_point(F.col("path")))
    repos = tree.select(F.col("repo").alias("full_name")).distinct().withColumns({"name": F.substring_index("full_name", "/", -1), "url": F.lit(None), "seq": F.lit(0)})
    _merge(graph, "Repository", repos)
    _merge(graph, "Directory", dirs)
    # A stored file keeps what is known of it, so that a scanned one is not read again.
    _merge(graph, "File", files.join(graph.label("File").select("path", "repo"), ["path", "repo"], "left_anti"))
    _link(graph, "CONTAINS_DIR", dirs.select(F.concat_ws("::", F.lit("Repository"), "repo").alias("src"), _path_id("Directory").alias("dst")))
    _link(graph, "CONTAINS_FILE", files.select(F.concat_ws("::", F.lit("Repository"), "repo").alias("src"), _path_id("File").alias("dst")))
    named = dirs.withColumn("label", F.lit("Directory")).select("repo", "path", "label").unionByName(files.withColumn("label", F.lit("File")).select("repo", "path", "label"))
    children = named.withColumn("parent", parent_of(F.col("path"))).where("parent IS NOT NULL")
    inside = upsert.conditional_edges(children, graph.label("Directory").select(F.col("path").alias("dir"), F.col("repo").alias("dir_repo")), ["parent", "repo"], ["dir", "dir_repo"])
    _link(graph, "CONTAINS", inside.select(_path_id("Directory", "parent").alias("src"), F.concat_ws("::", "label", "path", "repo").alias("dst")))
    return files.where(is_source(F.col("path"))).select("repo", "path", "pos")


def unscanned(graph: Graph, sources: DataFrame) -> DataFrame:
    """Source files without the scanned flag."""
    done = graph.label("File").where("content_scanned").select("repo", "path")
    return sources.join(done, ["repo", "path"], "left_anti")


def scan_contents(graph: Graph, sources: DataFrame, contents: DataFrame, embed: Callable[[Column], Column] = readers.embed, order_dependent: bool = False) -> DataFrame:
    """Phase 2: functions, calls and dependencies of the source files. Returns the files that were read.

    contents: repo, path, content (base64). A file without a body stays unscanned.
    """
    scratch = Scratch(graph.spark, "contents")
    texts = scratch.put(sources.join(contents, ["repo", "path"]).withColumn("text", readers.decode_content(F.col("content"))).where("text IS NOT NULL").drop("content"), "texts")
    parsed = scratch.put(syntax.parse_sources(texts).join(texts.select("repo", "path", "pos"), ["repo", "path"]), "parsed")
    functions = parsed.where("kind = 'function'").select(
        function_id(F.col("repo"), F.col("path"), F.col("name")).alias("id"), "name", F.col("path").alias("filepath"), "repo", "code", "walk_pos", F.col("pos").cast("bigint").alias("seq")
    )
    # Of equal names in a file, the first of the walk counts.
    first = traverse.first_n(functions, ["id"], [F.col("walk_pos")], 1).withColumn("embedding", embed(F.concat_ws("\n", "name", "code")))
    first = scratch.put(first.withColumn("unit", vectors.unit(F.col("embedding"))), "functions")
    _merge(graph, "Function", first)
    fn = F.concat_ws("::", F.lit("Function"), "id")
    _link(graph, "DECLARES", first.select(F.concat_ws("::", F.lit("File"), "filepath", "repo").alias("src"), fn.alias("dst")).unionByName(first.select(F.concat_ws("::", F.lit("Repository"), "repo").alias("src"), fn.alias("dst"))))
    calls = parsed.where("kind = 'call'").select("repo", F.concat_ws("::", F.lit("Function"), "repo", "path", "name").alias("caller_id"), "callee", F.col("pos").alias("caller_pos"))
    known = graph.label("Function").join(sources.select("repo", F.col("path").alias("filepath"), F.col("pos").alias("scan_pos")), ["repo", "filepath"], "left")
    _link(graph, "CALLS", traverse.resolve_calls(calls, known.select("repo", fn.alias("id"), "name", "scan_pos"), order_dependent))
    found = imports.source_imports(texts, ["repo", "path"])
    log = found.select(_path_id("File").alias("src"), F.concat_ws("::", F.lit("Module"), "target_module").alias("dst"), F.lit("add").alias("op"), F.lit(INITIAL).alias("sha"), F.lit(0).cast("bigint").alias("seq"), "target_module")
    add_dependencies(graph, scratch.put(log, "log"), embed)
    read = texts.select("repo", "path")
    scanned = read.withColumns({"entry_point": F.lit(None).cast("boolean"), "content_scanned": F.lit(True), "seq": F.lit(1)})
    _merge(graph, "File", scanned)
    return read


def add_dependencies(graph: Graph, log: DataFrame, embed: Callable[[Column], Column] = readers.embed) -> None:
    """Folds additions and removals (src, dst, op, sha, seq, target_module) onto the dependency edges.

    Modules that are new get a vector, computed once for each name.
    """
    names = log.where("op = 'add'").select(F.col("target_module").alias("name")).distinct()
    fresh = upsert.without_known(names, graph.label("Module"), "name")
    modules = readers.embed_distinct(fresh, "name", embed).withColumns({"unit": vectors.unit(F.col("embedding")), "seq": F.lit(0)})
    _merge(graph, "Module", modules)
    stored = graph.edges.get("DEPENDS_ON")
    graph.edges["DEPENDS_ON"] = upsert.temporal_edges(log, ("src", "dst"), stored).withColumn("type", F.lit("DEPENDS_ON"))


def ingest_commits(
    graph: Graph, repo: str, listed: DataFrame, details: DataFrame, history: DataFrame | None = None, as_of: Column | None = None, most: int = 200,
    force: bool = False, listing_order: bool = False, model: Callable[[list[str]], list[str]] | None = None, embed: Callable[[Column], Column] = readers.embed,
) -> DataFrame:
    """Phase 3: commits, authors, changed files and functions, and what the diffs add and remove. Returns the new commits.

    listed: repo, pos, sha, newest first; details: as `readers.flatten_details` gives them;
    history: repo, sha, path, content of recent commits' files. Dependencies apply
    oldest first, or as listed with `listing_order`. `model` answers batches of prompts;
    a commit without an answer, or all without a model, gets the summary made of its files.
    """
    scratch = Scratch(graph.spark, "commits")
    new = upsert.without_known(listed.where((F.col("repo") == repo) & (F.col("pos") < most)), graph.label("Commit"), "sha", force)
    commits = scratch.put(new.join(details, "sha"), "commits")
    compact = scratch.put(patches.compact_files(commits), "compact")
    texts = patches.diff_text(compact)
    notes = patches.summaries(commits.select("sha", "repo", "message"), compact)
    if model is not None:
        answers = readers.summarize_each(patches.prompts(commits.select("sha", "repo", "message"), texts), model).select("sha", F.col("summary_text").alias("answer"))
        notes = notes.join(answers, "sha", "left").select("sha", F.coalesce("answer", "summary_text").alias("summary_text"))
    seq = (F.col("pos") if listing_order else -F.col("pos")).cast("bigint")
    rows = commits.drop("files").join(texts, "sha", "left").join(notes, "sha", "left").withColumn("diff_text", F.coalesce("diff_text", F.lit(""))).withColumn("seq", seq)
    rows = scratch.put(rows, "described")  # a model is asked once
    _merge(graph, "Repository", graph.spark.createDataFrame([(repo, repo.rsplit("/", 1)[-1], None, 0)], "full_name string, name string, url string, seq int"))
    _merge(graph, "Commit", rows)
    _merge(graph, "User", commits.select(F.col("author").alias("login"), F.lit(0).alias("seq")))
    sha = F.concat_ws("::", F.lit("Commit"), "sha")
    _link(graph, "AUTHORED", commits.select(F.concat_ws("::", F.lit("User"), "author").alias("src"), sha.alias("dst")))
    _link(graph, "BELONGS_TO", commits.select(sha.alias("src"), F.concat_ws("::", F.lit("Repository"), "repo").alias("dst")))
    changed = compact.withColumn("repo", F.lit(repo)).withColumnRenamed("filename", "path")
    _merge(graph, "File", changed.select("path", "repo").distinct().withColumns({"entry_point": F.lit(None).cast("boolean"), "content_scanned": F.lit(None).cast("boolean"), "seq": F.lit(-1)}).join(graph.label("File").select("path", "repo"), ["path", "repo"], "left_anti"))
    _link(graph, "MODIFIED", changed.select(sha.alias("src"), _path_id("File").alias("dst")))
    _link(graph, "CONTAINS_FILE", changed.select(F.concat_ws("::", F.lit("Repository"), "repo").alias("src"), _path_id("File").alias("dst")))
    deps = imports.patch_imports(patches.signed_lines(changed.select("sha", "path", "patch"))).join(commits.select("sha", seq.alias("at")), "sha")
    # Within a commit additions come before removals.
    order = F.row_number().over(Window.partitionBy("path", "target_module").orderBy("at", "sha", "sign"))
    log = deps.withColumn("repo", F.lit(repo)).select(
        _path_id("File").alias("src"), F.concat_ws("::", F.lit("Module"), "target_module").alias("dst"), F.when(F.col("sign") == "+", "add").otherwise("remove").alias("op"), "sha", order.cast("bigint").alias("seq"), "target_module"
    )
    add_dependencies(graph, scratch.put(log, "log"), embed)
    if history is not None:
        recent = commits.where(patches.within_window(F.col("timestamp"), as_of if as_of is not None else F.current_timestamp())).select("sha")
        _link(graph, "MODIFIED", modified_functions(repo, changed.join(recent, "sha", "left_semi"), history))
    return commits.select("sha")


def modified_functions(repo: str, changed: DataFrame, history: DataFrame) -> DataFrame:
    """Edges from commits to the functions whose lines their hunks meet. changed: sha, path, patch."""
    bodies = history.where(F.col("repo") == repo).join(changed.select("sha", "path").distinct(), ["sha", "path"]).withColumn("text", readers.decode_content(F.col("content")))
    # The parser keys texts by repository and path: the commit rides along in the first.
    parsed = syntax.parse_sources(bodies.select(F.concat_ws("\n", "sha", "repo").alias("repo"), "path", "text")).where("kind = 'function'")
    functions = parsed.select(F.substring_index("repo", "\n", 1).alias("sha"), "path", F.concat_ws("::", F.lit("Function"), F.lit(repo), "path", "name").alias("id"), "start", "end")
    met = traverse.hunk_overlap(functions, patches.hunks(changed.select("sha", "path", "patch")))
    return met.select(F.concat_ws("::", F.lit("Commit"), "sha").alias("src"), F.col("id").alias("dst"))


def clean_orphans(graph: Graph) -> dict[str, int]:
    """Deletes files, directories and functions without a repository, with their edges; how many of each."""
    deleted = {}
    for label in ("File", "Directory", "Function"):
        rows = graph.label(label).withColumn("_id", F.concat_ws("::", F.lit(label), *X.KEYS[label]))
        doomed = F.col("repo").isNull()
        deleted[label] = rows.where(doomed).count()  # from a narrow scan, to leave the tables as they are where there are none
        if not deleted[label]:
            continue
        for kind in list(graph.edges):
            graph.edges[kind] = upsert.detach_delete(rows, graph.edges[kind], doomed, "_id")[1]
            graph.sizes.pop(kind, None)
        graph.forget(label, rows.where(doomed))
        graph.nodes[label] = rows.where(~doomed).drop("_id")
        graph.sizes[label] = graph.size(label, rows) - deleted[label]
    return deleted


def bootstrap(
    graph: Graph, repo: str, tree: DataFrame, contents: DataFrame, listed: DataFrame, details: DataFrame, at: Callable[[], str] | None = None,
    embed: Callable[[Column], Column] = readers.embed, **options,
) -> dict[str, int]:
    """All phases for one repository, resuming where an earlier run stopped, with status records in between. Returns the run's counters."""
    stamp = at or (lambda: datetime.now(timezone.utc).replace(tzinfo=None).isoformat())
    scratch = Scratch(graph.spark, "graph")
    run = {f"deleted_{k.lower()}s": n for k, n in clean_orphans(graph).items()} if graph.nodes else {}

    def phase(status: str, detail: str, work: Callable[[], DataFrame] | None = None, counter: str = "") -> DataFrame | None:
        before = _tables(graph)
        out, n = scratch.counted(work(), "phase") if work else (None, 0)
        if counter:
            run[counter] = n
        set_status(graph, repo, status, detail.format(n=n), run["commits_processed"], run["files_scanned"], stamp())
        for name, made in settle(graph, scratch, before).items():
            run[name] += made
        return out

    run |= dict.fromkeys(("commits_processed", "source_files", "files_scanned", "nodes_created", "relationships_created"), 0)
    phase("in_progress", "reading the file tree")
    sources = phase("in_progress", "{n} source files in the tree", lambda: scan_tree(graph, tree.where(F.col("repo") == repo)), "source_files")
    phase("in_progress", "{n} files scanned", lambda: scan_contents(graph, unscanned(graph, sources), contents, embed), "files_scanned")
    phase("in_progress", "{n} commits read", lambda: ingest_commits(graph, repo, listed, details, embed=embed, **options), "commits_processed")
    phase("completed", f"{run['files_scanned']} files scanned, {run['commits_processed']} commits ingested")
    return run


def load_repos(paths: Sequence[str], graph: Graph) -> dict[str, DataFrame]:
    """The inputs of a bootstrap from folders of JSON lines: tree, contents, commits, details and, if there is a fifth, the recent commits' files."""
    spark = graph.spark
    tree, contents, listed, details, *history = paths
    out = {"tree": readers.repo_tree(spark, tree), "contents": spark.read.schema(X.CONTENTS).json(contents), "listed": readers.commit_list(spark, listed), "details": readers.commit_details(spark, details)}
    return out | ({"history": spark.read.schema(X.HISTORY).json(history[0])} if history else {})


def fetch_repo(
    graph: Graph, repo: str, fetch: readers.Fetch, most: int = 200, ref: str = "HEAD", partitions: int = 8, force: bool = False, as_of: Column | None = None,
) -> dict[str, DataFrame]:
    """The inputs of a bootstrap from a hosting service's REST answers, each fetched once, and only what the graph doesn't have.

    Keys are paths below the service's base: the tree, the contents of source files that are
    not scanned yet, the pages of the commit list, the listed commits that are not stored
    (all of them with `force`), and of the recent ones the files as they were then. What can't
    be fetched is left out.
    """
    spark = graph.spark
    scratch = Scratch(spark, "fetched")

    def answers(keys: DataFrame, shape: str, name: str) -> DataFrame:
        got = scratch.put(readers.fetch_each(keys, "key", fetch, partitions), name)
        return keys.join(got.where("payload IS NOT NULL"), "key").withColumn("body", F.from_json("payload", shape)).drop("payload")

    base = f"repos/{repo}"
    at = lambda path, *tail: F.concat(F.lit(f"{base}/contents/"), readers.quoted(F.col(path)), *tail)
    root = spark.createDataFrame([(f"{base}/git/trees/{ref}?recursive=1",)], "key string")
    tree = answers(root, "tree array<struct<path: string, type: string>>", "tree").select(F.posexplode("body.tree").alias("pos", "e")).select(F.lit(repo).alias("repo"), "pos", "e.path", "e.type")
    tree = scratch.put(tree, "files")
    wanted = unscanned(graph, tree.where((F.col("type") == "blob") & ~is_noise(F.col("path")) & is_source(F.col("path"))).select("repo", "path"))
    contents = answers(wanted.select("path", at("path").alias("key")), "content string", "contents").select(F.lit(repo).alias("repo"), "path", F.col("body.content").alias("content"))
    listed = scratch.put(spark.read.format(host.register(spark, fetch)).option("repo", repo).option("most", most).load(), "listed")
    new = upsert.without_known(listed, graph.label("Commit"), "sha", force)
    got = scratch.put(readers.fetch_each(new.select(F.concat(F.lit(f"{base}/commits/"), "sha").alias("key")), "key", fetch, partitions), "details")
    details = scratch.put(readers.parse_details(got.where("payload IS NOT NULL")), "commits")
    recent = details.where(patches.within_window(F.col("timestamp"), as_of if as_of is not None else F.current_timestamp()))
    # Only files that have functions to be read.
    files = patches.compact_files(recent).select("sha", F.col("filename").alias("path")).where(F.col("path").rlike(r"\.(py|go)$"))
    then = answers(files.select("sha", "path", at("path", F.lit("?ref="), F.col("sha")).alias("key")), "content string", "history")
    history = then.select(F.lit(repo).alias("repo"), "sha", "path", F.col("body.content").alias("content"))
    return {"tree": tree, "contents": contents, "listed": listed, "details": details, "history": history}
