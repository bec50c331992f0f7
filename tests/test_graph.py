"""Folds, traversals, search and whole ingests on small graphs."""

import base64
import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftgraph import schema as X
from weftgraph.__main__ import main as command_line
from weftgraph.graph import Graph
from weftgraph.operators import search, traverse, upsert
from weftgraph.plans import ingest, retrieve
from weftgraph.plans.components import components, stars
from weftgraph.plans.engine import Engine, engine_at
from weftgraph.plans.materialize import Scratch
from weftgraph.sources import host, readers
from weftgraph.streaming import upserts

LOG = "src string, dst string, op string, sha string, seq long"


def replay(log):
    """The same edges by applying one write after the other."""
    edges = {}
    for src, dst, op, sha, _ in sorted(log, key=lambda r: r[4]):
        edge = edges.get((src, dst))
        if op == "add":
            if edge is None:
                edges[src, dst] = [sha, None, True]
            else:
                edge[2] = True
        elif edge is not None:
            edge[1:] = [sha, False]
    return {(k[0], k[1], *v) for k, v in edges.items()}


@pytest.mark.parametrize(
    ("ops", "want"),
    [
        ([("remove", "c1"), ("add", "c2"), ("remove", "c3"), ("add", "c4")], ("c2", "c3", True)), ([("add", "initial_scan"), ("remove", "c5")], ("initial_scan", "c5", False)),
        ([("remove", "c6")], None), ([("add", "c7"), ("remove", "c7")], ("c7", "c7", False)),
    ],
)
def test_temporal_fold(spark, ops, want):
    rows = upsert.temporal_edges(spark.createDataFrame([("a", "b", op, sha, n) for n, (op, sha) in enumerate(ops)], LOG)).collect()
    assert [tuple(r)[2:] for r in rows] == ([want] if want else [])


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.sampled_from("xyz"), st.sampled_from(["add", "remove"])), min_size=1, max_size=25), st.integers(0, 25))
def test_temporal_fold_equals_replay(spark, ops, cut):
    log = [(s, d, op, f"c{n}", n) for n, (s, d, op) in enumerate(ops)]
    frame = spark.createDataFrame(log, LOG)
    assert {tuple(r) for r in upsert.temporal_edges(frame).collect()} == replay(log)
    stored = upsert.temporal_edges(frame.where(F.col("seq") < cut))
    assert {tuple(r) for r in upsert.temporal_edges(frame.where(F.col("seq") >= cut), ("src", "dst"), stored).collect()} == replay(log)


def test_upsert_rules_and_idempotence(spark):
    batch = spark.createDataFrame([("k", "A", "x", 1), ("k", "B", None, 2), ("j", None, "y", 1)], "id string, code string, note string, seq long")
    once = upsert.upsert(None, batch, ["id"], ["code"], ["note"])
    assert {tuple(r) for r in once.collect()} == {("k", "A", None), ("j", None, "y")}
    assert {tuple(r) for r in upsert.upsert(once, batch, ["id"], ["code"], ["note"]).collect()} == {tuple(r) for r in once.collect()}


def test_edges_once_and_detach(spark):
    edges = spark.createDataFrame([("a", "T", "b"), ("a", "T", "b"), ("b", "T", "c")], "src string, type string, dst string")
    merged = upsert.merge_edges(upsert.merge_edges(None, edges), edges)
    assert merged.count() == 2
    nodes = spark.createDataFrame([("a", "r"), ("b", "r"), ("c", None)], "id string, repo string")
    kept, left = upsert.detach_delete(nodes, merged, F.col("repo").isNull())
    assert kept.count() == 2 and [tuple(r) for r in left.collect()] == [("a", "T", "b")]
    counts = upsert.mutation_counts(nodes.limit(0), nodes, ["id"]).first()
    assert (counts["created"], counts["deleted"]) == (3, 0)


NODE = "id string, label string, name string, path string, full_name string, filepath string, repo string, code string, embedding array<float>"


def small(spark):
    nodes = [
        ("F:x", "File", None, "x.py", None, None, "r1", None, None), ("F:y", "File", None, "y.py", None, None, "r1", None, None), ("fn:f", "Function", "f", None, None, "x.py", "r1", "def f(): g()", [1.0, 0.0]),
        ("fn:g", "Function", "g", None, None, "y.py", "r2", "def g(): pass", [1.0, 1.0]), ("fn:b", "Function", "b", None, None, "z.py", "r2", "b", [0.0, 1.0]), ("fn:c", "Function", "c", None, None, "z.py", "r2", "c", [-1.0, 0.0]),
        ("M:json", "Module", "json", None, None, None, None, None, None), ("M:old", "Module", "oldlib", None, None, None, None, None, None),
    ]
    edges = [("fn:f", "CALLS", "fn:g", True), ("F:x", "DEPENDS_ON", "M:json", True), ("F:x", "DEPENDS_ON", "M:old", False)]
    commits = [("c1aaaaaaa", "2024-01-01T00:00:00Z", "first fix", None, None, "r1"), ("c2bbbbbbb", "2024-02-01T00:00:00Z", "second\nline", None, None, "r1")]
    return retrieve.Corpus(
        spark.createDataFrame(nodes, NODE).withColumn("unit", search.unit(F.col("embedding"))), spark.createDataFrame(edges, "src string, type string, dst string, is_active boolean"),
        spark.createDataFrame(commits, "sha string, timestamp string, message string, summary_text string, diff_text string, repo string"),
        spark.createDataFrame([("u1", "c1aaaaaaa"), ("u2", "c2bbbbbbb")], "src string, dst string"), spark.createDataFrame([("c1aaaaaaa", "F:x"), ("c2bbbbbbb", "F:x"), ("c2bbbbbbb", "F:y")], "src string, dst string"),
    )


def test_vector_search(spark):
    c = small(spark)
    got = [(r["id"], round(r["score"], 6)) for r in search.vector_search(c.nodes, c.edges, [1.0, 0.0], 4).collect()]
    assert got == [("fn:f", 1.0), ("fn:g", 0.853553), ("fn:b", 0.5), ("fn:c", 0.0)]
    assert [r["id"] for r in search.vector_search(c.nodes, c.edges, [1.0, 0.0], 2, ["r2"]).collect()] == ["fn:g"]
    assert [r["id"] for r in search.vector_search(c.nodes, c.edges, [1.0, 0.0], 2, ["r2"], True).collect()] == ["fn:g", "fn:b"]
    first = search.vector_search(c.nodes, c.edges, [1.0, 0.0], 1).first()
    assert [x["name"] for x in first["connected"]] == ["g"]


def test_impact(spark):
    c = small(spark)
    walk = lambda s, **k: [(r["name"], r["rel_type"]) for r in traverse.impact(c.nodes, c.edges, spark.createDataFrame([(0, s)], "pos int, subject string"), **k).orderBy("ord_pos", "ord_seed", "ord_kind").collect()]
    assert walk("json") == [("json", traverse.SUBJECT), ("<unknown>", "DEPENDS_ON")]
    assert walk("oldlib") == [("oldlib", traverse.SUBJECT), ("<unknown>", "DEPENDS_ON")]
    assert walk("oldlib", only_active=True) == [("oldlib", traverse.SUBJECT)]
    assert ("f", "CALLS") in walk("g")
    assert ("g", "OUTBOUND_CALLS") in walk("f")
    assert walk("zzz") == []


def test_questions(spark):
    c = small(spark)
    text = lambda q, **k: retrieve.assemble(retrieve.retrieve_rows(c, q, **k)).first()
    blame = text("who changed x.py?", vector=[])
    assert "blame" in blame["path"] and blame["context"].index("c2bbbbbbb") < blame["context"].index("c1aaaaaaa")
    near = text("something near", vector=[1.0, 0.0], top_k=2)
    assert near["path"] == "vector-search"
    # f calls g, which is shown below it as it comes first there, and not once more as a record of its own.
    assert near["context"].count("Called/Dep: g  [y.py]") == 1 and "Function : f" in near["context"] and "Function : g" not in near["context"]
    files = text("what files did commit c2bbbbbbb change?", vector=[])
    assert files["path"] == "commit-file-lookup" and files["context"].count("Relation : FILE_CHANGED_BY_COMMIT") == 2
    recent = text("the latest 1 commits", vector=[])
    assert "recent-commits" in recent["path"] and "c2bbbbbbb" in recent["context"]
    assert text("nothing here", vector=[])["context"] == retrieve.NOTHING
    top = text("who wrote most?", vector=[])
    # Both authors have one commit; a block shows a commit text, file and function once.
    assert top["path"] == "blame-traversal" and top["context"].count("1 commits total") == 1 and "Author     : u1" in top["context"]


@pytest.mark.parametrize("bound", [100, 0])
def test_cross_repo_impact(spark, monkeypatch, bound):
    monkeypatch.setattr(traverse, "BROADCAST_CALLERS", bound)
    edge = "src string, dst string"
    changes, calls = spark.createDataFrame([("c", "fn:g")], edge), spark.createDataFrame([("fn:f", "fn:g"), ("fn:h", "fn:g")], edge)
    uses = traverse.cross_repo_links(spark.createDataFrame([("x.py", "My-Helper-lib"), ("y.py", "helper"), ("z.py", "json")], edge), "o/helper")
    functions = spark.createDataFrame([("fn:f", "f", "x.py"), ("fn:h", "h", "w.py")], "id string, name string, filepath string")
    ask = lambda sha, **k: {tuple(r) for r in traverse.cross_repo_impact(sha, "o/helper", changes, uses, calls, functions, **k).select("file_path", "function_name").collect()}
    assert ask("c") == {(f, n) for f in ("x.py", "y.py") for n in ("f", "h")}
    assert ask("unknown") == {("x.py", None), ("y.py", None)}
    assert ask("c", correlated=True) == {("x.py", "f"), ("y.py", None)}


def test_bm25_prefix(spark):
    docs = spark.createDataFrame([(n, "apple " * n + "pear") for n in range(1, 9)], "id int, t string")
    k = lambda n: [r["id"] for r in search.search(docs, "id", F.col("t"), "apple", n).collect()]
    assert k(3) == k(4)[:3] and k(1) == [8]


def test_components(spark):
    pairs = [(1, 2), (2, 3), (7, 8), (9, 9), (30, 20), (20, 10), *((i, i + 1) for i in range(100, 130))]
    df = spark.createDataFrame(pairs, "a long, b long")
    scratch = Scratch(spark, "test")
    want = {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 10: 10, 20: 10, 30: 10} | {i: 100 for i in range(100, 131)}
    assert {r["id"]: r["component"] for r in components(scratch, df, "a", "b").collect()} == want
    assert {r["id"]: r["component"] for r in stars(scratch, df.where("a <> b").toDF("u", "v")).collect()} == want
    assert components(scratch, df.limit(0), "a", "b").count() == 0


SOURCE = "import json\nfrom lib import x\n\ndef f():\n    return g()\n\ndef g():\n    return 1\n"


def inputs(tmp_path):
    def lines(name, rows):
        folder = tmp_path / name
        folder.mkdir()
        (folder / "a.json").write_text("\n".join(map(json.dumps, rows)))
        return str(folder)

    body = base64.b64encode(SOURCE.encode()).decode()
    tree = [("pkg", "tree"), ("pkg/a.py", "blob"), ("pkg/main.go", "blob"), ("node_modules/x.js", "blob"), ("README", "blob")]
    patch = "@@ -4,2 +4,2 @@\n def f():\n-import sys\n+import json\n+import newer"
    detail = lambda sha, day, files: {"sha": sha, "author": {"login": ""}, "commit": {"message": f"m {sha}", "author": {"name": "Ann", "date": f"2024-01-0{day}T00:00:00Z"}}, "files": files}
    one = {"filename": "pkg/a.py", "status": "modified", "patch": patch, "additions": 2, "deletions": 1, "changes": 3}
    two = one | {"patch": "@@ -1 +1 @@\n-import newer"}
    return [
        lines("tree", [{"repo": "o/r", "pos": n, "path": p, "type": t} for n, (p, t) in enumerate(tree)]), lines("contents", [{"repo": "o/r", "path": "pkg/a.py", "content": body}]),
        lines("listed", [{"repo": "o/r", "pos": 0, "sha": "new"}, {"repo": "o/r", "pos": 1, "sha": "old"}, {"repo": "o/r", "pos": 2, "sha": "lost"}]),
        lines("details", [detail("new", 2, [two]), detail("old", 1, [one])]),
    ]


def test_bootstrap(spark, tmp_path):
    engine = Engine(spark)
    assert engine.stats()["nodes"] == 0
    run = engine.bootstrap("o/r", inputs(tmp_path))
    g = engine.graph
    assert {r["path"] for r in g.label("File").collect()} == {"pkg/a.py", "pkg/main.go", "README"}
    assert {r["path"]: r["content_scanned"] for r in g.label("File").collect()}["pkg/a.py"] is True
    assert {r["name"] for r in g.label("Function").collect()} == {"f", "g"}
    assert [(r["src"], r["dst"]) for r in g.edge("CALLS").collect()] == [("Function::o/r::pkg/a.py::f", "Function::o/r::pkg/a.py::g")]
    deps = {r["dst"]: (r["added_in_commit"], r["deleted_in_commit"], r["is_active"]) for r in g.edge("DEPENDS_ON").collect()}
    assert deps == {"Module::json": ("initial_scan", None, True), "Module::lib": ("initial_scan", None, True), "Module::newer": ("old", "new", False)}
    assert {r["sha"] for r in g.label("Commit").collect()} == {"new", "old"} and {r["login"] for r in g.label("User").collect()} == {"Ann"}
    status = g.label("BootstrapStatus").first()
    assert (status["status"], status["commits_processed"], status["files_scanned"]) == ("completed", 2, 1) and status["updated_at"] and "2 commits" in status["detail"]
    edges = sum(g.edge(k).count() for k in g.edges)
    nodes = sum(g.label(k).count() for k in g.nodes)
    assert run == {"commits_processed": 2, "source_files": 2, "files_scanned": 1, "nodes_created": nodes, "relationships_created": edges}
    vectors = {r["name"]: r for r in g.label("Module").collect()}
    assert vectors.keys() == {"json", "lib", "newer"}
    assert all(r["embedding"] == pytest.approx(readers.hash_vector(n)) and sum(x * x for x in r["unit"]) == pytest.approx(1) for n, r in vectors.items())
    assert {r["name"]: sum(x * x for x in r["unit"]) for r in g.label("Function").collect()} == pytest.approx({"f": 1.0, "g": 1.0})
    stats = engine.stats()
    assert stats["functions"] == 2 and stats["commits"] == 2 and stats["issues"] == 0
    path = str(tmp_path / "graph")
    engine.save(path)
    again = Engine(spark, path=path)
    assert again.check() and again.repos() == ["o/r"] and again.stats() == stats
    assert engine_at(spark, path) is engine_at(spark, path)
    asked = again.graph.index_texts().ask("m old")
    assert again.graph.texts["Commit"].store.folders[0].endswith("/texts/Commit") and [r["sha"] for r in asked.collect()] == ["old", "new"]
    plan = asked._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and "explode" not in plan  # no text is cut into words for a question
    again.graph.nodes["File"] = again.graph.label("File").unionByName(spark.createDataFrame([("lost", None, None, None)], X.NODES["File"]))
    counts = again.bootstrap("o/r", inputs_of(tmp_path))
    assert counts == {"deleted_files": 1, "deleted_directorys": 0, "deleted_functions": 0, "commits_processed": 0, "source_files": 2, "files_scanned": 0, "nodes_created": 0, "relationships_created": 0}
    assert again.stats() == stats  # nothing new: the same graph
    assert "Function : f" in again.retrieve("what does f return", top_k=2)
    assert again.chat("what does f return", model=lambda p: "one")["answer"] == "one"


def inputs_of(tmp_path):
    return [str(tmp_path / n) for n in ("tree", "contents", "listed", "details")]


def test_modified_functions(spark):
    body = base64.b64encode(SOURCE.encode()).decode()
    changed = spark.createDataFrame([("s", "a.py", "@@ -1 +4,2 @@\n x")], "sha string, path string, patch string")
    history = spark.createDataFrame([("r", "s", "a.py", body)], "repo string, sha string, path string, content string")
    assert [tuple(r) for r in ingest.modified_functions("r", changed, history).collect()] == [("Commit::s", "Function::r::a.py::f")]


def test_local_tree(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg" / "a.py").write_text(SOURCE)
    tree, contents = readers.local_tree(spark, str(tmp_path), "o/r")
    assert {(r["path"], r["type"]) for r in tree.collect()} == {("pkg", "tree"), ("pkg/a.py", "blob")}
    graph = Graph(spark)
    sources = ingest.scan_tree(graph, tree)
    ingest.scan_contents(graph, sources, contents)
    assert graph.label("Function").count() == 2


def test_summaries_by_a_model(spark, tmp_path):
    """A commit that the model doesn't answer has the summary made of its files."""
    engine = Engine(spark)
    engine.bootstrap("o/r", inputs(tmp_path), model=lambda prompts: [("short " + p.split("Message: ")[1].split("\n")[0]) if "m new" in p else " " for p in prompts])
    got = {r["sha"]: r["summary_text"] for r in engine.graph.label("Commit").collect()}
    assert got["new"] == "short m new" and got["old"].startswith("Commit in o/r: m old\nKey files: pkg/a.py (modified, +2/-1).")

    def broken(prompts):
        raise OSError("away")

    prompts = spark.createDataFrame([("s", "p")], "sha string, prompt string")
    assert readers.summarize_each(prompts, broken).first()["summary_text"] is None


def answers():
    """A hosting service's answers to the keys of one repository."""
    body = base64.b64encode(SOURCE.encode()).decode()
    files = [{"filename": "pkg/a.py", "status": "modified", "patch": "@@ -1 +1 @@\n+import newer", "additions": 1, "deletions": 0, "changes": 1}]
    known = {
        "repos/o/r/git/trees/HEAD?recursive=1": {"tree": [{"path": p, "type": t} for p, t in (("pkg", "tree"), ("pkg/a.py", "blob"), ("pkg/b.go", "blob"), ("README", "blob"))]},
        "repos/o/r/contents/pkg/a.py": {"content": body}, "repos/o/r/commits?per_page=100&page=1": [{"sha": f"s{n:03d}"} for n in range(100)], "repos/o/r/commits?per_page=100&page=2": [{"sha": "last"}],
        "repos/o/r/commits/s000": {"sha": "s000", "commit": {"message": "first", "author": {"name": "Ann", "date": "2024-01-01T00:00:00Z"}}, "files": files},
        "repos/o/r/commits/last": {"sha": "last", "commit": {"message": "last", "author": {"name": "Bob", "date": "2023-01-01T00:00:00Z"}}, "files": []},
    }
    texts = {k: json.dumps(v) for k, v in known.items()}
    return lambda key: (200, texts[key], {}) if key in texts else (404, None, {})


def test_bootstrap_from_answers(spark):
    engine = Engine(spark)
    run = engine.fetch("o/r", answers(), most=150)
    assert (run["commits_processed"], run["source_files"], run["files_scanned"]) == (2, 2, 1)
    assert {r["sha"] for r in engine.graph.label("Commit").collect()} == {"s000", "last"} and engine.stats()["functions"] == 2


def host_answers(log, commits, stamp):
    """A service whose requests are written to a file, as tasks run in processes of their own."""
    body = base64.b64encode(SOURCE.encode()).decode()
    files = [{"filename": "pkg/é x.py", "status": "modified", "patch": "@@ -1 +4,2 @@\n+import newer", "additions": 1, "deletions": 0, "changes": 1}]

    def fetch(key):
        with open(log, "a") as out:
            out.write(key + "\n")
        if "/git/trees/" in key:
            return 200, json.dumps({"tree": [{"path": p, "type": "blob"} for p in ("pkg/é x.py", "pkg/b#?.go", "broken.py")]}), {}
        if "/contents/broken" in key:
            raise RuntimeError("of any kind")
        if "/contents/" in key:
            return 200, json.dumps({"content": body}), {}
        if "/commits?" in key:
            return 200, json.dumps([{"sha": s} for s in commits]) if "&page=1" in key else "[]", {}
        sha = key.rsplit("/", 1)[1]
        return 200, json.dumps({"sha": sha, "commit": {"message": sha, "author": {"name": "Ann", "date": stamp if sha != "old" else "2020-01-01T00:00:00Z"}}, "files": files}), {}

    return fetch


def test_a_second_fetch_asks_for_what_is_new(spark, tmp_path):
    log, stamp = tmp_path / "log", "2024-05-05T00:00:00Z"
    asked = lambda: sorted(log.read_text().split("\n")[:-1])
    options = {"most": 100, "as_of": F.to_timestamp(F.lit("2024-05-06 00:00:00"))}
    engine = Engine(spark)
    run = engine.fetch("o/r", host_answers(log, ["new", "old"], stamp), **options)
    assert run["commits_processed"] == 2 and run["files_scanned"] == 2
    assert asked() == sorted([
        "repos/o/r/git/trees/HEAD?recursive=1", "repos/o/r/contents/broken.py", "repos/o/r/contents/pkg/%C3%A9%20x.py", "repos/o/r/contents/pkg/b%23%3F.go",
        "repos/o/r/commits?per_page=100&page=1", "repos/o/r/commits/new", "repos/o/r/commits/old", "repos/o/r/contents/pkg/%C3%A9%20x.py?ref=new",
    ])
    # The recent commit changed a function: blame can follow it.
    assert ("Commit::new", "Function::o/r::pkg/é x.py::f") in {(r["src"], r["dst"]) for r in engine.graph.edge("MODIFIED").collect()}
    known = {r["name"]: list(r["embedding"]) for r in engine.graph.label("Function").collect()}
    code = engine.graph.label("Function").where("name = 'f'").first()["code"]
    assert known["f"] == pytest.approx(readers.hash_vector(f"f\n{code}"))
    log.unlink()
    run = engine.fetch("o/r", host_answers(log, ["newest", "new", "old"], stamp), **options)
    assert run["commits_processed"] == 1
    assert asked() == sorted(["repos/o/r/git/trees/HEAD?recursive=1", "repos/o/r/contents/broken.py", "repos/o/r/commits?per_page=100&page=1", "repos/o/r/commits/newest", "repos/o/r/contents/pkg/%C3%A9%20x.py?ref=newest"])


def test_commit_list_as_a_stream(spark, tmp_path):
    log = tmp_path / "log"
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def run(commits):
        name = host.register(spark, host_answers(log, commits, ""), "commit_list_test")
        rows = spark.readStream.format(name).option("repo", "o/r").load()
        rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(once=True).start().awaitTermination(120)
        return sorted(r["sha"] for r in spark.read.parquet(out).collect())

    assert run(["c2", "c1"]) == ["c1", "c2"]
    assert run(["c4", "c3", "c2", "c1"]) == ["c1", "c2", "c3", "c4"]  # each once
    stream = host._Stream(host._Host(host_answers(log, [f"c{k}" for k in range(9, 0, -1)], ""), {"repo": "o/r"}))
    rows, end = stream.read({"sha": "c4"})
    assert [r[2] for r in rows] == ["c5", "c6", "c7", "c8", "c9"] and end == {"sha": "c9"}
    assert [r[2] for r in stream.readBetweenOffsets({"sha": "c4"}, {"sha": "c6"})] == ["c5", "c6"]


def test_odd_paths_and_cut_connections():
    fetch = readers.http_fetch("http://127.0.0.1:1", timeout=1)
    for key in ("a b/c.py", "é.py", "a\nb", "ok"):
        assert readers.with_retries(fetch, key, lambda s: None) is None

    def broken(key):
        raise KeyError(key)

    assert readers.with_retries(broken, "k") is None


def test_retries():
    waits = []
    script = iter([(429, None, {"Retry-After": "7"}), (503, None, {}), (403, None, {"X-RateLimit-Remaining": "0"}), (500, None), (200, "body", {})])
    assert readers.with_retries(lambda k: next(script), "k", waits.append) == "body" and waits == [7.0, 2.0, readers.RATE_LIMIT_PAUSE, 8.0]

    def late(key):
        raise TimeoutError

    waits.clear()
    assert readers.with_retries(late, "k", waits.append) is None and waits == [1.0, 2.0, 4.0, 8.0]
    assert readers.with_retries(lambda k: (403, None, {}), "k", waits.append) is None and len(waits) == 4


def test_http_fetch():
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            seen.append((self.path, self.headers.get("Authorization")))
            self.send_response(200 if self.path == "/api/x" else 429)
            self.send_header("Retry-After", "3")
            self.end_headers()
            self.wfile.write(b"{}" if self.path == "/api/x" else b"")

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    fetch = readers.http_fetch(f"http://127.0.0.1:{server.server_port}/api/", "secret")
    assert fetch("x")[:2] == (200, "{}") and fetch("y")[0] == 429 and readers.pause_of(*fetch("y")[::2], 0) == 3.0
    server.shutdown()
    assert seen[0] == ("/api/x", "Bearer secret")


def test_command_line(spark, tmp_path, capsys):
    env = {"WEFT_REPO": "o/r", "WEFT_GRAPH": str(tmp_path / "none"), "WEFT_OUT": str(tmp_path / "out"), "WEFT_LOG": "ERROR", "WEFT_INPUTS": ",".join(inputs(tmp_path))}
    assert command_line({"WEFT_REPO": "o/r"}, spark) == 1 and "WEFT_API or WEFT_INPUTS" in capsys.readouterr().err
    assert command_line(env, spark) == 0 and "commits_processed 2" in capsys.readouterr().out
    assert Engine(spark, path=env["WEFT_OUT"]).stats()["commits"] == 2


def test_offline_vectors(spark):
    """By a plain version: words hashed to signed places."""
    import zlib

    texts = ["a b a", "", None, "Émile über", "x" * 50 + " y"]
    got = [r["e"] for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(readers.embed(F.col("t")).alias("e")).collect()]
    for text, vector in zip(texts, got, strict=True):
        want = [0.0] * 64
        word = ""
        for ch in (text or "").lower() + " ":
            if ch in "abcdefghijklmnopqrstuvwxyz0123456789":
                word += ch
            elif word:
                code = zlib.crc32(word.encode())
                want[code % 64] += 1 if code & 1 << 16 else -1
                word = ""
        length = sum(x * x for x in want) ** 0.5
        assert vector == (pytest.approx([x / length for x in want], abs=1e-6) if length else [])


def test_fetch_each(spark):
    keys = spark.createDataFrame([("a",), ("b",)], "sha string")
    got = {r["sha"]: r["payload"] for r in readers.fetch_each(keys, "sha", lambda k: (200, k * 2) if k == "a" else (404, None), 2).collect()}
    assert got == {"a": "aa", "b": None}


def test_stream_upsert_over_batches(spark, tmp_path):
    source, table, check = (str(tmp_path / n) for n in ("in", "table", "check"))
    kind = "k string, v string, seq long"
    for batch in ([("a", "1", 1), ("b", "1", 5)], [("a", "2", 3), ("b", "0", 2)]):
        spark.createDataFrame(batch, kind).coalesce(1).write.mode("append").parquet(source)
        rows = spark.readStream.schema(kind).parquet(source)
        upserts.run_to_end(lambda rows=rows: upserts.stream_upsert(rows, table, check, ["k"], [], ["v"]))
    versions = upserts.Versions(spark, table, ["k"])
    got = {r["k"]: r["v"] for r in versions.latest().collect()}
    assert got == {"a": "2", "b": "1"}  # a late write doesn't undo a later one
    # Only the buckets that a batch touches are written anew, and two versions of each are kept.
    for batch in range(3):
        spark.createDataFrame([("a", str(batch), 10 + batch)], kind).coalesce(1).write.mode("append").parquet(source)
        upserts.run_to_end(lambda: upserts.stream_upsert(spark.readStream.schema(kind).parquet(source), table, check, ["k"], [], ["v"]))
    assert {r["k"]: r["v"] for r in versions.latest().collect()} == {"a": "2", "b": "1"}
    kept = sorted(len(p) for p in versions._of_buckets(2**62).values())
    assert kept == [2, 2] and versions.before(1).count() <= 2


def test_windowed_counts(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 03:00:00", "b", 1.0)], "ts string, event_type string, value double")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = upserts.windowed_counts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("windowed").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(r["event_type"], r["n"], r["total"]) for r in spark.table("windowed").orderBy("start").collect()][:1] == [("a", 2, 3.0)]


def test_schema_keys():
    assert all(set(X.KEYS[k]) <= set(X.NODES[k].fieldNames()) for k in X.NODES)
