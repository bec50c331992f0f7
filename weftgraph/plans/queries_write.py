"""Upserts, deletes and incremental steps, each as one fold over a log."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph import schema as X
from weftgraph.functions import patches
from weftgraph.functions.paths import basename_of, extension_of, file_kind, is_entry_point, is_noise, is_source, is_utility_dir, parent_of, stem_of
from weftgraph.operators import upsert
from weftgraph.plans.projection import SQL as GRAPH
from weftgraph.plans.projection import change_graph, dependencies, dependency_log, files
from weftgraph.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _with(body: str) -> str:
    return f"WITH {GRAPH.rstrip()}{body if body.startswith(',') else ' ' + body}"


def _writes(spark, sf):
    """Events as writes to users' records, ordered by time and id."""
    return table(spark, sf, "events").select("user_id", "event_type", "value", "ts", "event_id")


#: The columns that order them.
BY_TIME = ("ts", "event_id")


@_query("SELECT user_id, arg_min(event_type, (ts, event_id)) AS event_type, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def upsert_first_write(spark, sf):
    """Values that only the first write of a key sets."""
    return upsert.upsert(None, _writes(spark, sf), ["user_id"], first=["event_type", "event_id"], seq=BY_TIME)


@_query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def upsert_last_write(spark, sf):
    """Values that every write of a key overwrites."""
    return upsert.upsert(None, _writes(spark, sf), ["user_id"], last=["event_type", "event_id"], seq=BY_TIME)


@_query("""SELECT user_id, CASE WHEN user_id % 2 = 0 THEN 'stored' ELSE arg_min(event_type, (ts, event_id)) END AS event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id""")
def upsert_onto_existing(spark, sf):
    """A batch of writes onto stored keys: first writes of stored keys stay."""
    batch = _writes(spark, sf)
    stored = batch.where("user_id % 2 = 0").select("user_id").distinct().withColumns({"event_type": F.lit("stored"), "event_id": F.lit(-1).cast("bigint")})
    return upsert.upsert(stored, batch, ["user_id"], first=["event_type"], last=["event_id"], seq=BY_TIME)


@_query("SELECT DISTINCT user_id FROM events")
def merge_node_keys(spark, sf):
    rows = table(spark, sf, "events").select("user_id")
    return upsert.merge_node(rows.where("user_id % 3 = 0"), rows, ["user_id"])


@_query("SELECT DISTINCT 'o' || l_orderkey AS src, 'MODIFIED' AS type, 'p' || l_partkey AS dst FROM lineitem")
def edge_dedup(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("src"), F.lit("MODIFIED").alias("type"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"))
    return upsert.merge_edges(None, rows)


@_query(_with("SELECT src, dst FROM calls JOIN func a ON a.id = src JOIN func b ON b.id = dst WHERE NOT starts_with(a.repo, 'ASIA') AND NOT starts_with(b.repo, 'ASIA')"))
def detach_delete(spark, sf):
    """Edges that stay when the functions of one region are deleted with theirs."""
    g = change_graph(spark, sf)
    functions = g.node_view("Function")
    return upsert.detach_delete(functions, g.edge("CALLS").select("src", "dst"), F.col("repo").startswith("ASIA"))[1]


_DEPS = "SELECT src, dst, added_in_commit, deleted_in_commit, is_active FROM deps"


@_query(_with(_DEPS))
def temporal_deps(spark, sf):
    """Dependency edges after all changes in the order of time."""
    return dependencies(spark, sf)


@_query(_with(_DEPS).replace("ORDER BY l_shipdate, l_orderkey, l_returnflag = 'R'", "ORDER BY l_shipdate DESC, l_orderkey DESC, l_returnflag = 'R'"))
def temporal_deps_listing_order(spark, sf):
    """The same when commits apply newest first, as a listing has them."""
    log = dependency_log(spark, sf).withColumns({"at": -F.unix_micros(F.col("at").cast("timestamp")), "nr": -F.col("nr")})
    return upsert.temporal_edges(log, ("src", "dst"), seq=("at", "nr", "late"))


@_query(_with("SELECT src, dst, added_in_commit FROM deps WHERE is_active"))
def temporal_active_only(spark, sf):
    return dependencies(spark, sf).where("is_active").select("src", "dst", "added_in_commit")


@_query(_with(_DEPS))
def temporal_deps_incremental(spark, sf):
    """Two batches, the second onto the edges of the first: the result of one."""
    log = dependency_log(spark, sf)
    early = F.col("at") < F.lit("1995-06-01").cast("timestamp_ntz")
    stored = upsert.temporal_edges(log.where(early), ("src", "dst"), seq=("at", "nr", "late"))
    return upsert.temporal_edges(log.where(~early), ("src", "dst"), stored, ("at", "nr", "late"))


@_query("SELECT count(*) FILTER (NOT known) AS created, count(*) FILTER (NOT kept) AS deleted FROM (SELECT user_id, bool_or(event_type = 'click') AS known, bool_or(event_type = 'view') AS kept FROM events WHERE event_type IN ('click', 'view') GROUP BY user_id)")
def mutation_counters(spark, sf):
    rows = table(spark, sf, "events")
    return upsert.mutation_counts(rows.where("event_type = 'click'"), rows.where("event_type = 'view'"), ["user_id"])


@_query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def incremental_anti(spark, sf):
    """Listed commits that aren't stored yet."""
    known = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return upsert.without_known(table(spark, sf, "orders").select("o_orderkey"), known, "o_orderkey")


@_query(_with("SELECT path FROM file WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_quantity < 4)"))
def resume_anti(spark, sf):
    """Source files that were not scanned yet."""
    rows = files(spark, sf)
    scanned = table(spark, sf, "lineitem").where("l_returnflag = 'A' AND l_quantity < 4").select(F.col("l_partkey").alias("p_partkey"))
    return upsert.without_known(rows, scanned, "p_partkey").select("path")


@_query(_with("SELECT path, repo, bool_or(l_returnflag = 'A') AS content_scanned FROM file JOIN lineitem ON l_partkey = p_partkey GROUP BY ALL"))
def set_flag(spark, sf):
    """Files with the flag that a scan of any of their lines sets."""
    log = files(spark, sf).join(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"), (F.col("l_returnflag") == "A").alias("content_scanned")), "p_partkey")
    return upsert.upsert(None, log.withColumn("seq", F.col("content_scanned").cast("int")), ["path", "repo"], last=["content_scanned"])


# Trees of paths: the pages' urls give directories and files.

_SEGMENTS = "list_filter(string_split(regexp_extract(url, '^[^:]+://([^?#]*)', 1), '/'), lambda s: s <> '')"
_TREE = f"""tree AS (SELECT DISTINCT array_to_string(s[1:n], '/') AS path, CASE WHEN n = len(s) THEN 'blob' ELSE 'tree' END AS type FROM (
  SELECT s, unnest(range(1, len(s) + 1)) AS n FROM (SELECT {_SEGMENTS} AS s FROM pages)))"""


def _tree(spark, sf):
    steps = F.filter(F.split(F.regexp_extract("url", "^[^:]+://([^?#]*)", 1), "/"), lambda s: s != "")
    rows = table(spark, sf, "pages").select(steps.alias("s")).select("s", F.explode(F.sequence(F.lit(1), F.size("s"))).alias("n"))
    return rows.select(F.array_join(F.slice("s", 1, F.col("n")), "/").alias("path"), F.when(F.col("n") == F.size("s"), "blob").otherwise("tree").alias("type")).distinct()


@_query(f"WITH {_TREE} SELECT DISTINCT c.path, regexp_replace(c.path, '/[^/]*$', '') AS parent_path FROM tree c JOIN tree p ON p.type = 'tree' AND p.path = regexp_replace(c.path, '/[^/]*$', '') AND contains(c.path, '/')")
def conditional_parent_edges(spark, sf):
    """Containment, only where the parent directory is in the tree."""
    tree = _tree(spark, sf)
    children = tree.select("path", parent_of(F.col("path")).alias("parent_path")).distinct()
    return upsert.conditional_edges(children, tree.where("type = 'tree'").select(F.col("path").alias("parent")), ["parent_path"], ["parent"])


def _list(values):
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_BASE = "lower(regexp_extract(path, '[^/]*$'))"


@_query(f"""WITH {_TREE} SELECT path, type, type = 'tree' AND {_BASE} IN {_list(X.UTILITY_DIRS)} AS utility, type = 'blob' AND regexp_replace({_BASE}, '\\.[^.]*$', '') IN {_list(X.ENTRY_POINT_NAMES)} AS entry_point FROM tree""")
def tree_flags(spark, sf):
    p, kind = F.col("path"), F.col("type")
    return _tree(spark, sf).select("path", "type", ((kind == "tree") & is_utility_dir(p)).alias("utility"), ((kind == "blob") & is_entry_point(p)).alias("entry_point"))


#: File names for the path filters: each page's last path step with endings in turn.
ENDINGS = (".py", ".PNG", ".go", "/node_modules/x.js", ".lock", "/go.mod", ".tar.gz", "/main.ts", "/README", ".R", "/Cargo.lock", "/dist/app.js")
_NAMED = f"""named AS (SELECT page_id, 'src/' || page_id || [{', '.join(f"'{e}'" for e in ENDINGS)}][page_id % {len(ENDINGS)} + 1] AS path FROM pages)"""


def _named(spark, sf):
    endings = F.array(*map(F.lit, ENDINGS))
    return table(spark, sf, "pages").select("page_id", F.concat(F.lit("src/"), F.col("page_id").cast("string"), F.get(endings, (F.col("page_id") % len(ENDINGS)).cast("int"))).alias("path"))


_NOISE = f"len(list_intersect(string_split(lower(path), '/'), {list(X.IGNORED_DIRECTORIES)})) > 0 OR {_BASE} IN {_list(X.IGNORED_FILENAMES)} OR regexp_matches({_BASE}, '({'|'.join(s.replace('.', chr(92) + '.') for s in X.IGNORED_SUFFIXES)})$')"


@_query(f"WITH {_NAMED} SELECT path, {_NOISE} AS noise FROM named")
def noise_filter(spark, sf):
    return _named(spark, sf).select("path", is_noise(F.col("path")).alias("noise"))


_EXT = "CASE WHEN contains(path, '.') THEN '.' || lower(regexp_extract(path, '[^.]*$')) ELSE '' END"


@_query(f"WITH {_NAMED} SELECT path FROM named WHERE NOT ({_NOISE}) AND ({_EXT} IN {_list(X.SOURCE_EXTENSIONS)} OR {_BASE} IN {_list(X.SOURCE_FILENAMES)})")
def source_files(spark, sf):
    p = F.col("path")
    return _named(spark, sf).where(~is_noise(p) & is_source(p)).select("path")


@_query(f"""WITH {_NAMED} SELECT path, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') END AS parent, regexp_extract(path, '[^/]*$') AS base, regexp_replace({_BASE}, '\\.[^.]*$', '') AS stem, {_EXT} AS extension,
  CASE WHEN {_BASE} = 'go.mod' THEN 'go_mod' WHEN {_BASE} = 'go.work' THEN 'go_work' WHEN ends_with({_BASE}, '.go') THEN 'go_source' END AS kind FROM named""")
def path_parts(spark, sf):
    p = F.col("path")
    return _named(spark, sf).select("path", parent_of(p).alias("parent"), basename_of(p).alias("base"), stem_of(p).alias("stem"), extension_of(p).alias("extension"), file_kind(p).alias("kind"))


# Diffs: an order is a commit, its lines are the changed files.

_PATCH = "repeat('+' || l_returnflag || chr(10), CAST(floor(l_quantity) AS INT) * 30)"
_DIFF = f"""ranked AS (SELECT md5(CAST(l_orderkey AS VARCHAR)) AS sha, 'src/' || l_partkey || '_' || l_suppkey || '.py' AS filename, CASE WHEN l_linestatus = 'O' THEN 'modified' ELSE 'added' END AS status,
  CAST(floor(l_quantity) AS INT) AS additions, l_linenumber AS deletions, CAST(floor(l_quantity) AS INT) + l_linenumber AS changes,
  CASE WHEN length({_PATCH}) > 4000 THEN substr({_PATCH}, 1, 4000) || chr(10) || '... [truncated]' ELSE {_PATCH} END AS patch,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY CAST(floor(l_quantity) AS INT) + l_linenumber DESC, l_suppkey * 100000 + l_partkey) AS rank FROM lineitem),
compact AS (SELECT * FROM ranked WHERE rank <= 12)"""


def _diff_files(spark, sf):
    items = table(spark, sf, "lineitem").withColumn("q", F.expr("cast(floor(l_quantity) as int)"))
    return items.select(
        F.md5(F.col("l_orderkey").cast("string")).alias("sha"), (F.col("l_suppkey") * 100000 + F.col("l_partkey")).alias("pos"),
        F.concat(F.lit("src/"), F.col("l_partkey").cast("string"), F.lit("_"), F.col("l_suppkey").cast("string"), F.lit(".py")).alias("filename"), F.lit(None).cast("string").alias("path"),
        F.when(F.col("l_linestatus") == "O", "modified").otherwise("added").alias("status"), F.expr("repeat(concat('+', l_returnflag, '\\n'), q * 30)").alias("patch"),
        F.col("q").alias("additions"), F.col("l_linenumber").alias("deletions"), (F.col("q") + F.col("l_linenumber")).alias("changes"),
    )


@_query(f"WITH {_DIFF} SELECT sha, filename, status, additions, deletions, changes, rank, length(patch) AS patch_chars, md5(patch) AS patch_md5 FROM compact")
def compact_diff(spark, sf):
    rows = patches.compact_diff(_diff_files(spark, sf))
    return rows.select("sha", "filename", "status", "additions", "deletions", "changes", F.col("rank").cast("bigint").alias("rank"), F.length("patch").cast("bigint").alias("patch_chars"), F.md5("patch").alias("patch_md5"))


@_query(f"""WITH {_DIFF} SELECT sha, md5(string_agg('File: ' || filename || chr(10) || 'Status: ' || status || chr(10) || 'Additions: ' || additions || chr(10) || 'Deletions: ' || deletions || chr(10) || 'Patch:' || chr(10) || patch, chr(10) || chr(10) ORDER BY rank)) AS text_md5 FROM compact GROUP BY sha""")
def render_diff(spark, sf):
    return patches.diff_text(patches.compact_diff(_diff_files(spark, sf))).select("sha", F.md5("diff_text").alias("text_md5"))


@_query(f"""WITH {_DIFF}, listed AS (SELECT sha, string_agg(filename || ' (' || status || ', +' || additions || '/-' || deletions || ')', ', ' ORDER BY rank) FILTER (rank <= 5) AS listed, count(*) AS n FROM compact GROUP BY sha)
  SELECT o.sha, CASE WHEN n IS NULL THEN 'Commit in shop: ' || left(message, 200) ELSE 'Commit in shop: ' || left(message, 100) || chr(10) || 'Key files: ' || listed || CASE WHEN n > 5 THEN ' and ' || (n - 5) || ' more' ELSE '' END || '.' END AS summary_text
  FROM (SELECT md5(CAST(o_orderkey AS VARCHAR)) AS sha, repeat(o_orderpriority || ' ', 20) AS message FROM orders) o LEFT JOIN listed USING (sha)""")
def heuristic_summary(spark, sf):
    commits = table(spark, sf, "orders").select(F.md5(F.col("o_orderkey").cast("string")).alias("sha"), F.lit("shop").alias("repo"), F.expr("repeat(concat(o_orderpriority, ' '), 20)").alias("message"))
    return patches.summaries(commits, patches.compact_diff(_diff_files(spark, sf)))


_HUNK = "'@@ -' || l_linenumber || ',3 +' || l_partkey || CASE l_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN ',0' ELSE ',' || l_linenumber END || ' @@'"


@_query(f"WITH h AS (SELECT DISTINCT md5(CAST(l_orderkey AS VARCHAR)) AS sha, l_suppkey || '.py' AS path, {_HUNK} || chr(10) || ' x' AS patch FROM lineitem), g AS (SELECT sha, path, CAST(regexp_extract(patch, '\\+(\\d+)', 1) AS INT) AS start, CASE regexp_extract(patch, '\\+\\d+(?:,(\\d+))? @@', 1) WHEN '' THEN 1 ELSE CAST(regexp_extract(patch, '\\+\\d+(?:,(\\d+))? @@', 1) AS INT) END AS count FROM h) SELECT * FROM g WHERE count > 0")
def hunk_parse(spark, sf):
    third = F.col("l_suppkey") % 3
    tail = F.when(third == 0, "").when(third == 1, ",0").otherwise(F.concat(F.lit(","), F.col("l_linenumber").cast("string")))
    patch = F.concat(F.lit("@@ -"), F.col("l_linenumber").cast("string"), F.lit(",3 +"), F.col("l_partkey").cast("string"), tail, F.lit(" @@\n x"))
    rows = table(spark, sf, "lineitem").select(F.md5(F.col("l_orderkey").cast("string")).alias("sha"), F.concat(F.col("l_suppkey").cast("string"), F.lit(".py")).alias("path"), patch.alias("patch")).distinct()
    return patches.hunks(rows)


@_query(_with("SELECT sha, coalesce(nullif(CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE author END, ''), nullif(CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE message END, ''), 'unknown') AS author, timestamp >= '1997-12-25T00:00:00Z' AS recent FROM commits"))
def author_and_window(spark, sf):
    """Author names with their fallbacks, and commits of the week before a day."""
    g = change_graph(spark, sf)
    rows = g.edge("AUTHORED").select(F.col("src").alias("login"), F.col("dst").alias("sha")).join(g.label("Commit"), "sha")
    nr = table(spark, sf, "orders").select(F.md5(F.col("o_orderkey").cast("string")).alias("sha"), "o_orderkey")
    rows = rows.join(nr, "sha")
    login = F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("login"))
    name = F.when(F.col("o_orderkey") % 6 == 0, "").otherwise(F.col("message"))
    return rows.select("sha", patches.author_of(login, name).alias("author"), patches.within_window(F.col("timestamp"), F.lit("1998-01-01 00:00:00").cast("timestamp")).alias("recent"))
