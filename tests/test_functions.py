"""Micro cases of paths, diffs, imports, syntax, routing and rendering."""

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import imports, patches, paths, render, router, syntax
from weftgraph.sources import readers


def one(spark, expression, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("path", "noise", "source", "entry", "utility"),
    [
        ("cmd", False, False, False, False), ("cmd/main.go", False, True, True, False), ("utils", False, False, False, True), ("utils/helper.py", False, True, False, False),
        ("node_modules/x/index.js", True, True, True, False), ("assets/logo.PNG", True, False, False, False), ("go.mod", False, True, False, False), ("a.b/c", False, False, False, False),
        ("README", False, False, False, False), ("a\\dist\\x.js", True, True, False, False), ("poetry.lock", True, False, False, False), ("x/Y.R", False, True, False, False), (".env", False, False, False, False),
    ],
)
def test_path_flags(spark, path, noise, source, entry, utility):
    p = F.col("p")
    row = spark.createDataFrame([(path,)], "p string").select(paths.is_noise(p), paths.is_source(p), paths.is_entry_point(p), paths.is_utility_dir(p)).first()
    assert tuple(row) == (noise, source, entry, utility)


def test_path_parts(spark):
    p = F.col("p")
    rows = spark.createDataFrame([("a/b.c/d.tar.GZ",), ("x",), ("a.b/c",)], "p string").select(paths.parent_of(p), paths.basename_of(p), paths.stem_of(p), paths.extension_of(p)).collect()
    assert [tuple(r) for r in rows] == [("a/b.c", "d.tar.GZ", "d.tar", ".gz"), (None, "x", "x", ""), ("a.b", "c", "c", ".b/c")]


def test_truncate(spark):
    assert one(spark, patches.truncate(F.col("t"), 4000), t="x" * 4001) == "x" * 4000 + "\n... [truncated]"
    assert one(spark, patches.truncate(F.col("t"), 4000), t="x" * 4000) == "x" * 4000
    assert one(spark, patches.truncate(F.col("t"), 4000), t=None) == ""


@pytest.mark.parametrize(("login", "name", "want"), [("", "Ann", "Ann"), ("", "", "unknown"), ("bo", "Ann", "bo"), (None, None, "unknown")])
def test_author(spark, login, name, want):
    assert one(spark, patches.author_of(F.col("a"), F.col("b")), a=login, b=name) == want


def test_hunks_and_signed_lines(spark):
    patch = "--- a\n+++ b\n@@ -1,3 +1,3 @@\n import os\n-import sys\n+import json\n@@ -9 +6 @@\n@@ -9 +8,0 @@\n@@ -9 +10,3 @@ f"
    rows = spark.createDataFrame([("s", "pkg/a.py", patch)], "sha string, path string, patch string")
    assert sorted((r["start"], r["count"]) for r in patches.hunks(rows).collect()) == [(1, 3), (6, 1), (10, 3)]
    assert sorted((r["sign"], r["line"]) for r in patches.signed_lines(rows).collect()) == [("+", "import json"), ("-", "import sys")]
    found = {(r["sign"], r["target_module"]) for r in imports.patch_imports(patches.signed_lines(rows)).collect()}
    assert found == {("+", "json"), ("-", "sys")}
    assert {r["target_module"] for r in imports.additive_patch_imports(rows).collect()} == {"os", "json"}


def test_compact_diff_order_noise_and_defaults(spark):
    rows = [("s", n, f"f{n}.py", None, None, "+x", 1, 0, n % 3) for n in range(15)] + [("s", 20, "dist/a.js", None, "added", "+x", 9, 9, 99), ("s", 21, "", "p.py", "added", "+y", 1, 1, 50), ("s", 22, "q.py", None, "added", "", 1, 1, 98)]
    kind = "sha string, pos int, filename string, path string, status string, patch string, additions int, deletions int, changes int"
    got = patches.compact_diff(spark.createDataFrame(rows, kind)).orderBy("rank").collect()
    assert len(got) == 12 and got[0]["filename"] == "p.py"
    assert [r["filename"] for r in got[1:6]] == ["f2.py", "f5.py", "f8.py", "f11.py", "f14.py"]
    assert got[1]["status"] == "modified"


def test_compact_files_equal_the_rows(spark):
    import random

    from weftgraph import schema as X
    from weftgraph.sources import readers

    rng = random.Random(4)
    pick = lambda *v: rng.choice(v)
    files = lambda n: [(pick(f"src/{k}.py", "yarn.lock", "", None), pick(None, f"p{k}.go"), pick(None, "added"), pick(None, "", "+x\n" * pick(1, 9)), pick(None, k), 1, pick(None, k % 5)) for k in range(n)]
    details = spark.createDataFrame([(f"s{k}", files(rng.randrange(0, 30)) if k else None) for k in range(40)], "sha string, files " + X.COMMIT_FILES.simpleString())
    got, want = patches.compact_files(details, 5, 10), patches.compact_diff(readers.exploded_files(details), 5, 10)
    rows = lambda df: sorted(map(str, df.select(*sorted(want.columns)).collect()))
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want) and got.count() > 100
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_summaries(spark):
    kind = "sha string, pos int, filename string, path string, status string, patch string, additions int, deletions int, changes int"
    compact = patches.compact_diff(spark.createDataFrame([("a", n, f"f{n}", None, "added", "+", 1, 2, 0) for n in range(7)], kind))
    commits = spark.createDataFrame([("a", "r", "m" * 300), ("b", "r", "n" * 300)], "sha string, repo string, message string")
    got = {r["sha"]: r["summary_text"] for r in patches.summaries(commits, compact).collect()}
    assert got["a"] == "Commit in r: " + "m" * 100 + "\nKey files: " + ", ".join(f"f{n} (added, +1/-2)" for n in range(5)) + " and 2 more."
    assert got["b"] == "Commit in r: " + "n" * 200


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("import os", ["os"]), ("from pkg.mod import thing", ["pkg.mod"]), ("import a, b", ["a"]), ("import React from 'react'", ["React", "react"]), ("const x = require('fs')", ["fs"]),
        ("#include <stdio.h>", ["stdio.h"]), ("use std::io;", ["std::io"]), ("# import hidden", []), ("x = 1  # because of y", ["of"]), ("", []),
    ],
)
def test_generic_imports(spark, line, want):
    rows = imports.imports(imports.source_lines(spark.createDataFrame([("a.py", line)], "path string, text string"), ["path"]), ["path"])
    assert [r["target_module"] for r in rows.orderBy("ord").collect()] == want


def test_go_imports():
    source = 'package a\nimport (\n\t"fmt"\n\talias "github.com/x/y"\n\t// "no"\n)\nimport "os"\nx := use\n'
    assert list(imports.go_targets(source.split("\n"))) == ["fmt", "github.com/x/y", "os"]
    module = "require (\n  github.com/a/b v1.0.0\n)\nrequire github.com/c/d v2.0.0\nreplace github.com/e/f => ../local\nuse ./tools\nreplace (\n a v1 => b v2\n)\n"
    assert list(imports.go_targets(module.split("\n"))) == ["github.com/a/b", "github.com/c/d", "github.com/e/f", "../local", "./tools", "a", "b"]
    assert list(imports.go_targets(['"fmt"'])) == []


def test_python_functions():
    source = "def f():\n    def g():\n        h()\n    return g()\n\nclass C:\n    async def f(self):\n        self.x()\n"
    functions, calls = syntax.python_functions("a.py", source)
    assert [(n, s, e) for n, s, e, _, _ in functions] == [("f", 1, 4), ("g", 2, 3), ("f", 7, 8)]
    assert sorted(calls) == [("f", "g"), ("f", "h"), ("g", "h")]
    assert syntax.python_functions("a.py", "def (") == ([], [])
    assert syntax.python_functions("a.js", source) == ([], [])


def test_go_functions():
    source = "package p\n// func no() {}\nfunc a(x struct{ y int }) interface{} {\n\ts := \"}\"\n\treturn fmt.Sprint(b(x), é(s))\n}\nfunc (r *R) b[T any](x T) int { return a(nil).c() }\n"
    functions, calls = syntax.go_functions("p.go", source)
    assert [(n, s, e) for n, s, e, _, _ in functions] == [("a", 3, 6), ("b", 7, 7)]
    assert functions[1][3].startswith("func (r *R) b") and functions[1][3].endswith("}")
    assert ("a", "Sprint") in calls and ("a", "b") in calls and ("a", "é") in calls and ("b", "a") in calls and ("b", "c") in calls


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("who changed auth.py?", {"blame": True, "func_hints": ["auth"], "file_hints": ["auth.py"], "impact": True, "subjects": [], "path_hints": [], "commit_gate": False}),
        ("show the last 5 commits of AFRICA/NATION_0", {"recency": True, "repo_hint": "AFRICA/NATION_0", "commit_limit": 5, "impact": False, "path_hints": ["nation_0"], "commit_files": False, "shas": []}),
        ("what files did commit e4da3b7 change?", {"shas": ["e4da3b7"], "commit_files": True, "impact": True, "subjects": [], "recency": False, "blame": False}),
        ("remove the Event field from struct BlockStorageResourceData", {"impact": True, "subjects": ["blockstorageresourcedata"], "field_hints": ["event"], "repo_hints": [], "commit_gate": False}),
        ("is this an important problem?", {"impact": True, "commit_gate": True, "subjects": []}),
        ("in 1999 what was new", {"commit_limit": 20}), ("the bubbles/help Help.go spinner", {"path_hints": ["help", "spinner"]}), ("commit ABCDEF1 and abcdef1", {"shas": ["ABCDEF1"]}),
        ("the orbiter-metering repo", {"repo_hints": ["orbiter-metering"], "commit_limit": 10}),
    ],
)
def test_router(spark, query, want):
    row = router.signals(spark.createDataFrame([(query,)], "query string")).first()
    assert {k: row[k] for k in want} == want


def test_sanitize(spark):
    assert one(spark, router.sanitize(F.col("q")), q="what is /hugo?") == "what is hugo"
    assert one(spark, router.sanitize(F.col("q")), q="???") == "???"


def test_mark_hit_lines(spark):
    assert one(spark, render.mark_hit_lines(F.col("c"), F.col("t")), c="a\nEvent x\nb", t="event") == "    a\n>>> Event x\n    b"
    assert one(spark, render.mark_hit_lines(F.col("c"), F.col("t")), c="a\nb", t="event") == "a\nb"
    assert one(spark, render.mark_hit_lines(F.col("c"), F.col("t")), c=None, t="event") == ""


ROW = "g int, ord long, source string, name string, func_name string, filepath string, repo string, rel_type string, code string, connected array<struct<name:string,path:string,code:string>>"


def test_context_block(spark):
    rows = [
        (1, 1, "s", "f", None, "a.py", "r", None, " code\n", [("g", "b.py", "x\ny"), ("h", "c.py", "")]), (1, 2, "s", "f", None, "a.py", "r", None, "again", []),
        (1, 3, "s", "g", None, "b.py", "", "CALLS", "seen below f", []), (1, 4, "s", "n", None, "d.py", None, None, "", []), (1, 5, "s", None, None, None, None, None, "z", []),
    ]
    text = render.context_block(spark.createDataFrame(rows, ROW), ["g"]).first()["block"]
    rule = "\n" + "─" * 60
    assert text == "\n".join(["[Source: s]", rule, "Function : f", "File     : a.py", "Repo     : r", "Code     :", "code", "\n  ↳ Called/Dep: g  [b.py]", "  x\n  y", rule, "Function : <unknown>", "File     : <unknown path>", "Code     :", "z"])
    whole = render.context_block(spark.createDataFrame(rows, ROW), ["g"], allow_no_code=True).first()["block"]
    assert "Code     : <not stored — structural reference only>" in whole


def test_blame_block_empty_message(spark):
    rows = spark.createDataFrame([(1, 1, "u", "c1", "", "d", "", "p"), (1, 2, "u", "c1", "x", "d", "", "p"), (1, 3, None, "c2", "one\ntwo", None, "f", "p")], "g int, ord long, author string, commit_sha string, commit_msg string, committed_at string, func_name string, filepath string")
    text = render.blame_block(rows, ["g"]).first()["block"]
    assert text.count("Commit SHA : c1") == 1 and "Message    : \nFile" in text and "Message    : one\nFunction   : f" in text and "Author     : <unknown>" in text


def test_readers(spark):
    assert one(spark, readers.decode_content(F.col("c")), c="w6kg\neA==") == "é x"
    assert "�" in one(spark, readers.decode_content(F.col("c")), c="/w==")
    assert one(spark, readers.decode_content(F.col("c")), c="***") is None
    answers = iter([(503, None), (429, None), (200, "body")])
    waits = []
    assert readers.with_retries(lambda k: next(answers), "k", waits.append) == "body" and waits == [1.0, 2.0]
    assert readers.with_retries(lambda k: (404, None), "k") is None
    vectors = spark.createDataFrame([("a b",), ("a b",), ("",), (None,)], "t string").select(readers.embed(F.col("t")).alias("v")).collect()
    assert vectors[0]["v"] == vectors[1]["v"] and len(vectors[0]["v"]) == readers.VECTOR_SIZE and vectors[2]["v"] == []
