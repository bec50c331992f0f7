"""One-hop traversals and the questions built on them.

Every edge pattern is an equi join; limits per seed, path or hint are windows
with a total order, which Spark prunes before it shuffles. Where a substring index of
the nodes is given (`grams`), nodes are found by it, else by a scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph import schema as X
from weftgraph.functions import patterns
from weftgraph.operators.filters import active_only, contains_ci, in_repos
from weftgraph.operators.substrings import MOST_NAMED, SubstringIndex, holding
from weftgraph.plans.adjacency import Adjacency, Changes, Edges
from weftgraph.plans.materialize import Scratch

# Fixed value: the relation of a subject to itself.
SUBJECT = "SUBJECT (being moved/refactored)"
#: Callers of one commit's changes that may be broadcast, and parts into which files are dealt beyond that.
BROADCAST_CALLERS = 100_000
DEALT = 64


def first_n(df: DataFrame, per: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """At most n rows of each group, in a given order."""
    rank = F.row_number().over(Window.partitionBy(*per).orderBy(*order))
    return df.withColumn("_n", rank).where(F.col("_n") <= n).drop("_n")


def first_seen(df: DataFrame, uid: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each uid."""
    return first_n(df, uid, [F.col(c) for c in order], 1)


def one_hop(edges: DataFrame, nodes: DataFrame, types: Sequence[str], out: bool = True, only_active: bool = False) -> DataFrame:
    """Seed id, edge type and the node at the other end."""
    near, far = ("src", "dst") if out else ("dst", "src")
    hop = active_only(edges.where(F.col("type").isin(*types)), only_active).select(F.col(near).alias("seed"), "type", F.col(far).alias("id"))
    return hop.join(nodes, "id")


def authored_changes(users_commits: DataFrame, commits: DataFrame, changes: DataFrame, belongs: DataFrame | None = None, repos: Sequence[str] | None = None) -> DataFrame:
    """User, commit and changed target: author, commit_sha, commit_msg, committed_at, target.

    Edge tables have src and dst; commits have their properties. `repos` needs `belongs`, commit to repository.
    """
    rows = (
        changes.select(F.col("src").alias("commit_sha"), F.col("dst").alias("target"))
        .join(commits.select(F.col("sha").alias("commit_sha"), F.coalesce("message", "summary_text", F.lit("")).alias("commit_msg"), F.col("timestamp").alias("committed_at")), "commit_sha")
        .join(users_commits.select(F.col("src").alias("author"), F.col("dst").alias("commit_sha")), "commit_sha")
    )
    if repos:
        rows = rows.join(belongs.where(F.col("dst").isin(*repos)).select(F.col("src").alias("commit_sha")).distinct(), "commit_sha", "left_semi")
    return rows


def latest(rows: DataFrame, per: Sequence[str], n: int = X.BLAME_LIMIT) -> DataFrame:
    """The n latest commits of each group; missing times count as latest, ties go by sha."""
    return first_n(rows, per, [F.desc_nulls_first("committed_at"), F.col("commit_sha")], n)


def blame_by_hint(rows: DataFrame, hints: DataFrame, path: str = "filepath", n: int = X.BLAME_LIMIT, grams: SubstringIndex | None = None) -> DataFrame:
    """The n latest commits to files whose path holds a hint, per hint. hints: hint (the words of one question).

    With `grams` the rows have their file's node as `target`.
    """
    held = holding(rows.withColumn("id", F.col("target") if grams else F.lit(None)), [path], hints, "hint", grams, indexed=["path"])
    return latest(held.drop("id"), ["hint"], n)


def top_authors(authored: DataFrame, belongs: DataFrame | None = None, repos: Sequence[str] | None = None, n: int = X.AUTHOR_LIMIT) -> DataFrame:
    if repos:
        authored = authored.join(belongs.where(F.col("dst").isin(*repos)).select(F.col("src").alias("dst")), "dst", "left_semi")
    return authored.groupBy(F.col("src").alias("author")).agg(F.count("*").alias("commit_count")).orderBy(F.desc("commit_count"), "author").limit(n)


def recent_commits(commits: DataFrame, n: int, repos: Sequence[str] | None = None) -> DataFrame:
    """The n latest commits with their text. commits: sha, timestamp, message, summary_text, diff_text, repo."""
    rows = in_repos(commits, repos)
    return rows.orderBy(F.desc_nulls_first("timestamp"), "sha").limit(n).select(F.col("sha").alias("name"), F.col("repo").alias("filepath"), F.coalesce("message", "summary_text", "diff_text", F.lit("")).alias("code"), "timestamp")


def commits_by_sha(commits: DataFrame, hints: DataFrame, grams: SubstringIndex | None = None) -> DataFrame:
    """Commits whose sha holds a hint anywhere. hints: hint (the words of one question); grams: by sha."""
    return holding(commits.withColumn("id", F.col("sha")), ["sha"], hints, "hint", grams).drop("id")


def commit_meta(commits: DataFrame, authored: DataFrame, hints: DataFrame, n: int = X.META_LIMIT, grams: SubstringIndex | None = None) -> DataFrame:
    found = Scratch(commits.sparkSession, "shas").put(commits_by_sha(commits, hints, grams), "found")
    few = found.select("sha").distinct().limit(MOST_NAMED + 1).collect()
    authored = authored.where(F.col("dst").isin([r["sha"] for r in few])) if len(few) <= MOST_NAMED else authored
    found = found.join(authored.select(F.col("src").alias("author"), F.col("dst").alias("sha")), "sha", "left")
    rows = found.select("hint", F.col("sha").alias("name"), F.coalesce("repo", F.lit("")).alias("repo"), F.coalesce("message", "summary_text", "diff_text", F.lit("")).alias("code"), F.coalesce("author", F.lit("")).alias("author"), F.col("timestamp").alias("committed_at"))
    return first_n(rows, ["hint"], [F.col("name"), F.col("author")], n)


def commit_targets(commits: DataFrame, changes: DataFrame | Changes, targets: DataFrame, hints: DataFrame, repos: Sequence[str] | None = None, n: int = X.COMMIT_ROWS, grams: SubstringIndex | None = None) -> DataFrame:
    """Files or functions that commits changed, at most n per hint by path and name. targets: id, name, filepath, code, label."""
    # What a hint names is written at each step: where it is little, Spark broadcasts it and moves no changes and targets.
    scratch = Scratch(commits.sparkSession, "shas")
    found = scratch.put(in_repos(commits_by_sha(commits, hints, grams), repos), "found")
    changes = changes.of_commits(found) if isinstance(changes, Changes) else changes
    found = scratch.put(found.join(changes.select(F.col("src").alias("sha"), F.col("dst").alias("id")), "sha"), "changes")
    rows = found.join(targets, "id")
    rows = rows.select(
        "hint", "name", "filepath", F.coalesce(found["repo"], F.lit("")).alias("repo"), F.concat(F.upper("label"), F.lit("_CHANGED_BY_COMMIT")).alias("rel_type"),
        F.coalesce("code", F.lit("")).alias("code"), F.col("sha").alias("commit_sha"), F.coalesce("message", "summary_text", F.lit("")).alias("commit_msg"),
    )
    return first_n(rows, ["hint"], [F.col("filepath"), F.col("name"), F.col("commit_sha")], n)


def impact_seeds(nodes: DataFrame, subjects: DataFrame, n: int = X.SEED_LIMIT, fallback: int = X.FALLBACK_LIMIT, grams: SubstringIndex | None = None) -> DataFrame:
    """Nodes whose name, path or full name holds a subject, n per subject; a subject without any gets files by path.

    subjects: pos, subject (those of one question). Returns pos, subject, seed, seed_name, seed_path, seed_label,
    as a written table of `n` rows a subject at most.
    """
    scratch = Scratch(nodes.sparkSession, "seeds")
    low = subjects.select("pos", F.lower("subject").alias("subject"))
    kinds = nodes.where(F.col("label").isin("Module", "Package", "File", "Function"))
    held = holding(kinds, ["name", "path", "full_name"], low, "subject", grams, n, F.col("label").isin("Module", "Package", "File", "Function"))
    found = held.select(
        "pos", "subject", F.col("id").alias("seed"), F.coalesce("name", "path", "full_name").alias("seed_name"), F.coalesce("path", "filepath", "full_name", F.lit("")).alias("seed_path"), F.col("label").alias("seed_label"),
    )
    seeds = scratch.put(first_n(found, ["pos"], [F.col("seed")], n), "seeds")
    has = {r["pos"] for r in seeds.select("pos").distinct().collect()}
    bare = [r["pos"] for r in subjects.select("pos").collect() if r["pos"] not in has]
    if not bare:
        return seeds
    low = low.where(F.col("pos").isin(*bare))
    # A file's path is among the columns above, so the second search finds nothing more unless those are bare.
    files = kinds.where("label = 'File'").join(F.broadcast(low), contains_ci(F.col("path"), F.col("subject"))).select("pos", "subject", F.col("id").alias("seed"), F.col("path").alias("seed_name"), F.col("path").alias("seed_path"), F.lit("File").alias("seed_label"))
    return scratch.put(seeds.unionByName(first_n(files, ["pos"], [F.col("seed")], fallback)), "all")


def impact_walk(seeds: DataFrame, nodes: DataFrame, edges: DataFrame | Adjacency | Edges, repos: Sequence[str] | None = None, only_active: bool = False) -> DataFrame:
    """Both kinds of neighbours of all seeds, in one pass over the edges; `out` tells what the seeds use.

    Of stored adjacency only the seeds' buckets are read.
    """
    if isinstance(edges, Adjacency | Edges):
        ids = [r["seed"] for r in seeds.select("seed").distinct().collect()]  # a question has few subjects, and each some tens of seeds at most
        # Written, as Spark then knows that they are few, and doesn't move nodes to them.
        edges = Scratch(nodes.sparkSession, "near").put(edges.edges_of(ids, True).unionByName(edges.edges_of(ids, False)).distinct(), "edges")
    ends = in_repos(nodes.where(F.col("label").isin("File", "Function", "Module")), repos)
    types = sorted({*X.CONSUMER_TYPES, *X.OUTBOUND_TYPES})
    inward = F.when(F.col("type").isin(*X.CONSUMER_TYPES), F.struct(F.col("dst").alias("seed"), F.col("src").alias("id"), F.lit(False).alias("out")))
    outward = F.when(F.col("type").isin(*X.OUTBOUND_TYPES), F.struct(F.col("src").alias("seed"), F.col("dst").alias("id"), F.lit(True).alias("out")))
    ways = active_only(edges.where(F.col("type").isin(*types)), only_active).select("type", F.explode(F.array_compact(F.array(inward, outward))).alias("way")).select("type", "way.*")
    # A question has few subjects, and each some tens of seeds at most.
    hop = ways.join(F.broadcast(seeds.select("seed").distinct()), "seed").join(ends, "id")
    rank = F.row_number().over(Window.partitionBy("seed", "out").orderBy("type", "id"))
    kept = hop.withColumn("_n", rank).where(F.col("_n") <= max(X.CONSUMER_LIMIT, X.OUTBOUND_LIMIT)).where(F.col("_n") <= F.when(F.col("out"), X.OUTBOUND_LIMIT).otherwise(X.CONSUMER_LIMIT))
    kind = F.when(F.col("out"), F.concat(F.lit("OUTBOUND_"), "type")).otherwise(F.col("type"))
    return kept.select("seed", "id", F.coalesce(F.nullif("name", F.lit("")), F.lit("<unknown>")).alias("name"), F.coalesce("filepath", "path", F.lit("")).alias("filepath"), F.coalesce("repo", F.lit("")).alias("repo"), kind.alias("rel_type"), F.coalesce("code", F.lit("")).alias("code"), F.coalesce("name", F.lit("None")).alias("raw_name"), "out")


def impact_neighbours(seeds: DataFrame, nodes: DataFrame, edges: DataFrame | Adjacency | Edges, out: bool, repos: Sequence[str] | None = None, only_active: bool = False) -> DataFrame:
    """Consumers of the seeds, or (out) what they use: a limited number per seed, by type and id."""
    return impact_walk(seeds, nodes, edges, repos, only_active).where(F.col("out") == out).drop("out")


def impact(nodes: DataFrame, edges: DataFrame | Adjacency | Edges, subjects: DataFrame, repos: Sequence[str] | None = None, only_active: bool = False, grams: SubstringIndex | None = None) -> DataFrame:
    """Seeds, their consumers and what they use, each path and name once, in the order of a walk seed by seed.

    Returns ord_pos, ord_seed, ord_kind, ord_id for the order, then name, filepath, repo, rel_type, code.
    """
    seeds = impact_seeds(nodes, subjects, grams=grams)
    place = seeds.select("seed", "pos")
    own = seeds.select("pos", "seed", F.lit(0).alias("kind"), F.col("seed").alias("id"), F.col("seed_name").alias("name"), F.col("seed_path").alias("filepath"), F.lit("").alias("repo"), F.lit(SUBJECT).alias("rel_type"), F.lit("").alias("code"), F.col("seed_name").alias("raw_name"))
    near = impact_walk(seeds, nodes, edges, repos, only_active).join(F.broadcast(place), "seed").withColumn("kind", F.when(F.col("out"), 2).otherwise(1)).drop("out")
    rows = own.unionByName(near)
    once = first_seen(rows, ["filepath", "raw_name"], ["pos", "seed", "kind", "rel_type", "id"])
    return once.select(F.col("pos").alias("ord_pos"), F.col("seed").alias("ord_seed"), F.col("kind").alias("ord_kind"), F.col("id").alias("ord_id"), "name", "filepath", "repo", "rel_type", "code")


def _coded(repos: Sequence[str] | None, *labels: str) -> Column:
    """The condition over a substring index's nodes: those with code, of some labels and repositories."""
    out = F.col("coded")
    out = out & F.col("label").isin(*labels) if labels else out
    return out & F.col("repo").isin(*repos) if repos else out


def subject_definition(nodes: DataFrame, subject: str, repos: Sequence[str] | None = None, grams: SubstringIndex | None = None) -> DataFrame:
    """The node with the longest code whose name holds the subject."""
    rows = in_repos(nodes.where(F.col("label").isin("Function", "File") & F.col("code").isNotNull()), repos)
    words = nodes.sparkSession.createDataFrame([(subject,)], "subject string")
    held = holding(rows, ["name"], words, "subject", grams, 1, _coded(repos, "Function", "File"), [F.desc("size"), F.col("id")])
    best = held.orderBy(F.length("code").desc(), "id").limit(1)
    return best.select("id", "name", F.coalesce("filepath", "path", F.lit("")).alias("filepath"), F.coalesce("repo", F.lit("")).alias("repo"), "code", F.lit("SUBJECT_DEFINITION").alias("rel_type"))


def field_grep(functions: DataFrame, fields: DataFrame, repos: Sequence[str] | None = None, n: int = X.FIELD_LIMIT, grams: SubstringIndex | None = None) -> DataFrame:
    """Functions whose code holds a field, n per field, tagged with it. fields: field (the words of one question)."""
    rows = holding(in_repos(functions.where("code IS NOT NULL"), repos), ["code"], fields, "field", grams, n, _coded(repos, "Function"))
    return first_n(rows, ["field"], [F.col("id")], n).withColumn("rel_type", F.concat(F.lit("REFERENCES_FIELD_"), F.upper("field")))


def path_boost(functions: DataFrame, hints: DataFrame, repos: Sequence[str] | None = None, n: int = X.HINT_LIMIT, grams: SubstringIndex | None = None) -> DataFrame:
    """Functions with code whose path holds a hint, n per hint. hints: hint (the words of one question)."""
    rows = holding(in_repos(functions.where("code IS NOT NULL"), repos), ["filepath"], hints, "hint", grams, n, _coded(repos, "Function"))
    return first_n(rows, ["hint"], [F.col("id")], n)


def resolve_calls(calls: DataFrame, functions: DataFrame, order_dependent: bool = False) -> DataFrame:
    """Edges from a caller to every function of the called name in its repository.

    calls: repo, caller_id, callee, caller_pos; functions: repo, id, name, scan_pos.
    `order_dependent` keeps only callees that were scanned before.

    There are as many edges as pairs of equal names, so both sides are made distinct and the pairs
    are not moved again; only those of ids that stand under several names can repeat. Both sides are
    dealt by repository and name and made distinct where they then lie, so that a row moves once.
    """
    # By hashes, of 96 bits for a name. Ids of one hash are taken for one, which costs no edge.
    names = functions.where("repo IS NOT NULL AND name IS NOT NULL").select(F.xxhash64("id").alias("_id"), F.xxhash64("repo", "name").alias("a"), F.hash("repo", "name").alias("b")).repartition("_id").distinct()
    # Written, as Spark then knows that they are few.
    several = Scratch(functions.sparkSession, "names").put(names.groupBy("_id").agg(F.count("*").alias("n")).where("n > 1").select("_id"), "several")
    dealt = calls.select("repo", F.col("callee").alias("name"), F.col("caller_id").alias("id"), F.col("caller_pos").alias("pos")).repartition("repo", "name")
    once = dealt.groupBy("repo", "name", F.col("id").alias("src")).agg(F.max("pos").alias("caller_pos"))
    dealt = functions.select("repo", "name", "id", F.col("scan_pos").alias("pos")).repartition("repo", "name")
    named = dealt.groupBy("repo", "name", F.col("id").alias("dst")).agg(F.min("pos").alias("scan_pos")).withColumn("_id", F.xxhash64("dst"))

    def edges(how: str) -> DataFrame:
        rows = once.join(named.join(several, "_id", how), ["repo", "name"])
        if order_dependent:
            rows = rows.where("scan_pos <= caller_pos")
        return rows.select("src", F.lit("CALLS").alias("type"), "dst")

    return edges("left_anti").unionByName(edges("left_semi").distinct())


def hunk_overlap(functions: DataFrame, hunks: DataFrame) -> DataFrame:
    """Functions whose lines meet a changed range: an equi join on the file, then the interval test.

    functions: sha, path, id, start, end; hunks: sha, path, start, count.
    """
    ranges = hunks.select("sha", "path", F.col("start").alias("first"), (F.col("start") + F.col("count") - 1).alias("last"))
    return functions.join(ranges, ["sha", "path"]).where((F.col("start") <= F.col("last")) & (F.col("end") >= F.col("first"))).select("sha", "path", "id").distinct()


def cross_repo_links(dependencies: DataFrame, helper: str) -> DataFrame:
    """Files that depend on a module whose name holds the helper repository's own name. dependencies: src, dst (module name)."""
    own = helper.rsplit("/", 1)[-1]
    return dependencies.where(contains_ci(F.col("dst"), own)).select("src", F.lit("USES_REPO").alias("type"), F.lit(helper).alias("dst")).distinct()


def cross_repo_links_of_all(dependencies: DataFrame, helpers: DataFrame) -> DataFrame:
    """The same for all helper repositories at once, in one pass over the modules for each `patterns.PART` names. helpers: full_name."""
    named = helpers.where("full_name IS NOT NULL").select("full_name", F.lower(F.substring_index("full_name", "/", -1)).alias("pattern")).distinct()
    scratch = Scratch(dependencies.sparkSession, "links")
    names = scratch.put(named.select("pattern").distinct().orderBy("pattern"), "names").orderBy("pattern")
    modules = dependencies.select("dst").distinct()
    found, part = [], []
    for r in names.toLocalIterator():  # of the automaton's patterns, a part at a time is on the driver
        part.append(r["pattern"])
        if len(part) == patterns.PART:
            found.append(patterns.holds_any(modules, "dst", part))
            part = []
    if part or not found:
        found.append(patterns.holds_any(modules, "dst", part))
    links = reduce(DataFrame.unionByName, found).join(named, "pattern").select("dst", "full_name")
    return dependencies.join(links, "dst").select("src", F.lit("USES_REPO").alias("type"), F.col("full_name").alias("dst")).distinct()


def cross_repo_impact(sha: str, helper: str, changes: DataFrame, uses: DataFrame, calls: DataFrame, functions: DataFrame, correlated: bool = False) -> DataFrame:
    """Files that use a helper repository beside functions that call what a commit changed.

    Files and functions stand side by side, tied only with `correlated`, then by
    path. Without a caller the files stay. Up to `BROADCAST_CALLERS` callers, counted
    first, are broadcast to the files; more are dealt, so that each of `DEALT` parts
    of the files meets all of them.
    """
    changed = changes.where(F.col("src") == sha).select(F.col("dst").alias("dst"))
    callers = calls.join(changed, "dst", "left_semi").select(F.col("src").alias("id")).distinct().join(functions, "id").select(F.col("name").alias("function_name"), F.col("filepath").alias("function_path"))
    files = uses.where(F.col("dst") == helper).select(F.col("src").alias("file_path")).distinct()
    if correlated:
        return files.join(callers, F.col("file_path") == F.col("function_path"), "left").distinct()
    callers = callers.distinct()
    if callers.limit(BROADCAST_CALLERS + 1).count() <= BROADCAST_CALLERS:
        return files.join(F.broadcast(callers), F.lit(True), "left")
    part = F.pmod(F.xxhash64("file_path"), F.lit(DEALT)).cast("int")
    everywhere = callers.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
    return files.withColumn("part", part).join(everywhere, "part", "left").drop("part")
