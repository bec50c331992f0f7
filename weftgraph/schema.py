"""Node and edge tables of the code-knowledge graph, and its fixed word lists and limits."""

from __future__ import annotations

from pyspark.sql import types as T

S, B, I, L = T.StringType(), T.BooleanType(), T.IntegerType(), T.LongType()
VECTOR = T.ArrayType(T.FloatType())
#: A vector scaled to length 1, which is what searches read.
UNIT = T.ArrayType(T.DoubleType())


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


#: Properties of each node label; the first ones are its key.
NODES = {
    "Repository": _table(full_name=S, name=S, url=S),
    "Directory": _table(path=S, repo=S, utility=B),
    "File": _table(path=S, repo=S, entry_point=B, content_scanned=B),
    "Function": _table(id=S, name=S, filepath=S, repo=S, code=S, embedding=VECTOR, unit=UNIT),
    "Module": _table(name=S, embedding=VECTOR, unit=UNIT),
    "Commit": _table(sha=S, timestamp=S, summary_text=S, diff_text=S, message=S, url=S),
    "User": _table(login=S),
    "BootstrapStatus": _table(repo=S, status=S, detail=S, commits_processed=I, files_scanned=I, updated_at=S),
    "Issue": _table(id=S),
    "Package": _table(name=S),
}
KEYS = {
    "Repository": ["full_name"], "Directory": ["path", "repo"], "File": ["path", "repo"], "Function": ["id"], "Module": ["name"],
    "Commit": ["sha"], "User": ["login"], "BootstrapStatus": ["repo"], "Issue": ["id"], "Package": ["name"],
}
#: Properties that the first write sets; all others follow the last write.
FIRST_WRITE = {
    "Repository": ["name", "url"], "Directory": ["utility"], "File": ["entry_point"], "Function": ["name", "filepath", "repo", "code", "embedding", "unit"],
    "Module": ["embedding", "unit"],
}
EDGE = _table(src=S, type=S, dst=S, added_in_commit=S, deleted_in_commit=S, is_active=B)
EDGE_TYPES = ("DECLARES", "CALLS", "MODIFIED", "AUTHORED", "BELONGS_TO", "CONTAINS_FILE", "CONTAINS_DIR", "CONTAINS", "DEPENDS_ON", "USES_REPO")
#: Edge types that impact traversals follow, towards and away from a seed.
CONSUMER_TYPES = ("DEPENDS_ON", "IMPORTS", "CALLS", "USES", "INCLUDES")
OUTBOUND_TYPES = ("DEPENDS_ON", "IMPORTS", "CALLS", "USES")

#: The row that every retrieval stage returns.
CONNECTED = T.ArrayType(_table(name=S, path=S, code=S))
RETRIEVED = T.StructType(
    [T.StructField("stage", I), T.StructField("ord", L), *_table(source=S, name=S, filepath=S, repo=S, rel_type=S, code=S).fields, T.StructField("connected", CONNECTED),
     T.StructField("score", T.DoubleType()), *_table(author=S, commit_sha=S, commit_msg=S, committed_at=S, func_name=S).fields]
)

# Shapes of what the ingest reads.
TREE = _table(repo=S, pos=I, path=S, type=S)
CONTENTS = _table(repo=S, path=S, content=S)
HISTORY = _table(repo=S, sha=S, path=S, content=S)
COMMIT_LIST = _table(repo=S, pos=I, sha=S)
COMMIT_FILES = T.ArrayType(_table(filename=S, path=S, status=S, patch=S, additions=I, deletions=I, changes=I))
COMMIT_DETAIL = T.StructType(
    [T.StructField("sha", S), T.StructField("html_url", S), T.StructField("author", _table(login=S)),
     T.StructField("commit", T.StructType([T.StructField("message", S), T.StructField("author", _table(name=S, date=S))])), T.StructField("files", COMMIT_FILES)]
)

# What counts as source, entry point, utility folder and noise.
SOURCE_EXTENSIONS = (".py", ".js", ".jsx", ".ts", ".tsx", ".go", ".java", ".rs", ".rb", ".php", ".c", ".cpp", ".h", ".hpp", ".cs", ".swift", ".kt", ".scala", ".r", ".vue", ".svelte")
SOURCE_FILENAMES = ("go.mod", "go.work")
ENTRY_POINT_NAMES = ("main", "index", "app", "server", "__main__", "manage", "wsgi", "asgi", "cli", "entrypoint")
UTILITY_DIRS = ("utils", "util", "lib", "libs", "common", "shared", "helpers", "helper", "core", "pkg", "internal")
IGNORED_DIRECTORIES = ("node_modules", "venv", ".venv", "env", "dist", "build", ".next", ".git")
IGNORED_FILENAMES = (".ds_store", "cargo.lock", "gemfile.lock", "package-lock.json", "poetry.lock", "pnpm-lock.yaml", "yarn.lock")
IGNORED_SUFFIXES = (
    ".bin", ".dll", ".exe", ".gif", ".gz", ".ico", ".jpeg", ".jpg", ".lock", ".mp3", ".mp4", ".pdf", ".png", ".so", ".svg", ".tar",
    ".tgz", ".ttf", ".woff", ".woff2", ".zip",
)

# Limits of the stages.
TOP_K = 5
CONNECTED_MOST = 4
SEED_LIMIT, FALLBACK_LIMIT, CONSUMER_LIMIT, OUTBOUND_LIMIT, FIELD_LIMIT = 20, 10, 30, 20, 20
HINT_LIMIT, BLAME_LIMIT, AUTHOR_LIMIT, FULLTEXT_LIMIT, META_LIMIT, COMMIT_ROWS = 8, 5, 10, 10, 5, 50
RECENT_DEFAULT, RECENT_MOST = 10, 20
DIFF_FILES, PATCH_CHARS, SUMMARY_FILES = 12, 4000, 5
DEEP_SCAN_DAYS = 7
