"""Dependencies named by source text.

Most languages: six patterns are tried on every line, all as columns. Go files
and modules have blocks that span lines; their lines are walked in order.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.paths import file_kind

# The patterns, in the order in which they are tried.
IMPORT_PATTERNS = (
    r"^\s*from\s+([a-zA-Z0-9_./@+-]+)\s+import",
    r"^\s*import\s+([a-zA-Z0-9_./@+-]+)",
    r"from\s+['\"]([^'\"]+)['\"]",
    r"require\(['\"]([^'\"]+)['\"]\)",
    r"#include\s*[<\"]([^>\"]+)[>\"]",
    r"use\s+([a-zA-Z0-9_:]+)",
)
_QUOTED = re.compile(r'["`]\s*([^"`]+?)\s*["`]')


def generic_imports(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct (keys, target_module) with `ord`, the place of the first mention. lines: keys, pos, line."""
    text = F.regexp_replace("line", r"^\s+|\s+$", "")
    stripped = lines.withColumn("line", text).where((F.length("line") > 0) & (~F.col("line").startswith("#") | F.col("line").startswith("#include")))
    found = F.array(*(F.regexp_extract("line", p, 1) for p in IMPORT_PATTERNS))
    each = stripped.select(*keys, "pos", F.posexplode(found).alias("which", "target_module")).where("target_module <> ''")
    return each.groupBy(*keys, "target_module").agg(F.min(F.col("pos").cast("long") * len(IMPORT_PATTERNS) + F.col("which")).alias("ord"))


def go_targets(lines: Iterable[str]) -> Iterator[str]:
    """Targets in reading order, with repeats: imports, and what module files require, use or replace."""
    block = None
    for raw in lines:
        line = raw.strip()
        if not line or line.startswith("//"):
            continue
        word = line.split(None, 1)[0]
        opened = re.match(r"(import|require|use|replace) \(", line)
        # An import block is left only by its own end; the others give way to a new opener.
        if opened and (opened[1] == "import" or block != "import"):
            block = opened[1]
            continue
        inside = block is not None
        if block != "import" and line.startswith("import "):
            if m := _QUOTED.search(line):
                yield m[1]
            continue
        if inside and line.startswith(")"):
            block = None
            continue
        kind, body = (block, line) if inside else (word, line[len(word) :].strip())
        if kind == "import":
            if inside and (m := _QUOTED.search(line)):
                yield m[1]
        elif kind == "require":
            if len(body.split()) >= 2:
                yield body.split()[0]
        elif kind == "use":
            if body:
                yield body
        elif kind == "replace" and "=>" in body:
            for side in body.split("=>", 1):
                if side.strip():
                    yield side.split()[0]


def _go_rows(keys: list[str]):
    def run(batches):
        for pdf in batches:
            rows = []
            for given in pdf.itertuples(index=False):
                seen = dict.fromkeys(go_targets(given.lines))
                rows += [(*(getattr(given, k) for k in keys), target, n) for n, target in enumerate(seen)]
            yield pd.DataFrame(rows, columns=[*keys, "target_module", "ord"])

    return run


def go_targets_of(texts: DataFrame, keys: list[str]) -> DataFrame:
    """The same for Go: the lines of each text are read in order. texts: keys, lines."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.select(*keys).schema)
    return texts.select(*keys, "lines").mapInPandas(_go_rows(keys), f"{kinds}, target_module string, ord long")


def go_imports(lines: DataFrame, keys: list[str]) -> DataFrame:
    """The same of single lines, put together in their order: keys, pos, line."""
    texts = lines.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("l")).select(*keys, F.transform("l", lambda x: x["line"]).alias("lines"))
    return go_targets_of(texts, keys)


def imports(lines: DataFrame, keys: list[str], path: str = "path") -> DataFrame:
    """Dependencies of each text, by the kind of its file. lines: keys with the path, pos, line."""
    kind = file_kind(F.col(path))
    go = go_imports(lines.where(kind.isNotNull()), keys)
    return generic_imports(lines.where(kind.isNull()), keys).unionByName(go)


def source_imports(files: DataFrame, keys: list[str], path: str = "path", text: str = "text") -> DataFrame:
    """Dependencies of whole texts, whose lines stay where the text is. files: keys with the path, text."""
    kind = file_kind(F.col(path))
    go = go_targets_of(files.where(kind.isNotNull()).select(*keys, F.split(text, "\n").alias("lines")), keys)
    return generic_imports(source_lines(files.where(kind.isNull()), keys, text), keys).unionByName(go)


def source_lines(files: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, pos, line of whole texts."""
    return files.select(*keys, F.posexplode(F.split(text, "\n")).alias("pos", "line"))


def patch_imports(signed: DataFrame, keys: Sequence[str] = ("sha", "path")) -> DataFrame:
    """Dependencies that a patch adds (sign +) and removes (-). signed: keys with the path, sign, pos, line.

    Patches that are already dealt by some of the keys are not dealt again.
    """
    return imports(signed, [*keys, "sign"])


def additive_patch_imports(patches: DataFrame, keys: Sequence[str] = ("sha", "path")) -> DataFrame:
    """Dependencies on the new side of a patch: added and context lines. patches: keys with the path, patch."""
    lines = patches.select(*keys, F.posexplode(F.split("patch", "\n")).alias("pos", "raw")).where(F.substring("raw", 1, 1).isin("+", " "))
    return imports(lines.select(*keys, "pos", F.ltrim(F.expr("substring(raw, 2)")).alias("line")), [*keys])
