"""Functions and calls of source files, by Python's own parser and by a small reader of Go."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def python_functions(path: str, source: str | None) -> tuple[list[tuple], list[tuple]]:
    """(name, start, end, code, walk_pos) of each function, breadth first, and (caller, callee) of calls by bare name.

    Calls of an inner function count for the outer ones too. A text that doesn't parse has none.
    """
    if not path.endswith(".py") or not source:
        return [], []
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return [], []
    functions, calls = [], []
    for node in ast.walk(tree):
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            functions.append((node.name, node.lineno, node.end_lineno, ast.get_source_segment(source, node) or "", len(functions)))
            calls += [(node.name, c.func.id) for c in ast.walk(node) if isinstance(c, ast.Call) and isinstance(c.func, ast.Name)]
    return functions, calls


_GO_TOKEN = re.compile(r"//[^\n]*|/\*.*?\*/|`[^`]*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])+'|[^\W\d]\w*|\d[\w.]*|\S", re.S)
_GO_WORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())


def go_functions(path: str, source: str | None) -> tuple[list[tuple], list[tuple]]:
    """The same for Go: declared functions and methods, and calls by name or by the last part of a selector."""
    if not path.endswith(".go") or not source:
        return [], []
    tokens = [m for m in _GO_TOKEN.finditer(source) if not m[0].startswith(("//", "/*"))]
    words = [m[0] for m in tokens]

    def past(at: int, opening: str, closing: str) -> int:
        """The place after the bracket that closes the one at `at`."""
        depth = 0
        while at < len(words):
            depth += (words[at] == opening) - (words[at] == closing)
            at += 1
            if not depth:
                break
        return at

    functions, calls, at, depth = [], [], 0, 0
    while at < len(words):
        depth += (words[at] == "{") - (words[at] == "}")
        if words[at] != "func" or depth:
            at += 1
            continue
        first = at
        at += 1
        if at < len(words) and words[at] == "(":
            at = past(at, "(", ")")
        if at >= len(words) or not re.match(r"[^\W\d]", words[at]):
            continue
        name = words[at]
        at += 1
        if at < len(words) and words[at] == "[":
            at = past(at, "[", "]")
        at = past(at, "(", ")") if at < len(words) and words[at] == "(" else at
        line = source.count("\n", 0, tokens[first].start())
        # The body is the first brace of the line that is no part of a result type.
        while at < len(words) and words[at] != "{" and "\n" not in source[tokens[at - 1].end() : tokens[at].start()]:
            opener = words[at + 1] if at + 1 < len(words) else ""
            if words[at] in ("interface", "struct") and opener == "{":
                at = past(at + 1, "{", "}")
            elif words[at] == "(":
                at = past(at, "(", ")")
            else:
                at += 1
        body = at
        if at < len(words) and words[at] == "{":
            at = past(at, "{", "}")
        end = tokens[at - 1].end()
        functions.append((name, line + 1, source.count("\n", 0, end) + 1, source[tokens[first].start() : end], len(functions)))
        for k in range(body, at - 1):
            if words[k + 1] == "(" and re.match(r"[^\W\d]", words[k]) and words[k] not in _GO_WORDS:
                calls.append((name, words[k]))
    return functions, calls


_SCHEMA = "repo string, path string, kind string, name string, callee string, start int, `end` int, code string, walk_pos int"


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for repo, path, text in zip(pdf["repo"], pdf["path"], pdf["text"], strict=True):
            functions, calls = (go_functions if path.endswith(".go") else python_functions)(path, text)
            rows += [(repo, path, "function", name, None, start, end, code, pos) for name, start, end, code, pos in functions]
            rows += [(repo, path, "call", caller, callee, None, None, None, n) for n, (caller, callee) in enumerate(calls)]
        out = pd.DataFrame(rows, columns=["repo", "path", "kind", "name", "callee", "start", "end", "code", "walk_pos"])
        yield out.astype({"start": "Int32", "end": "Int32"})


def parse_sources(files: DataFrame) -> DataFrame:
    """Rows of kind `function` and `call` of each source file. files: repo, path, text."""
    return files.where(F.col("path").rlike(r"\.(py|go)$") & F.col("text").isNotNull()).select("repo", "path", "text").mapInPandas(_read, _SCHEMA)
