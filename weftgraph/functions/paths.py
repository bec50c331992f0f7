"""Columns over file paths: parts, noise, source files, flags."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftgraph import schema as X


def parent_of(path: Column) -> Column:
    """The path without its last segment; null at the top."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", ""))


def basename_of(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension_of(path: Column) -> Column:
    """From the last point of the whole path on, in lower case; '' without a point."""
    return F.when(F.instr(path, ".") > 0, F.concat(F.lit("."), F.lower(F.substring_index(path, ".", -1)))).otherwise(F.lit(""))


def stem_of(path: Column) -> Column:
    """The last segment in lower case without its last extension."""
    return F.lower(F.regexp_replace(basename_of(path), r"\.[^.]*$", ""))


def is_noise(path: Column) -> Column:
    """Vendored, built, locked or binary files."""
    low = F.replace(F.lower(path), F.lit("\\"), F.lit("/"))
    base = basename_of(low)
    suffixes = "(" + "|".join(re.escape(s) for s in X.IGNORED_SUFFIXES) + ")$"
    return F.arrays_overlap(F.split(low, "/"), F.array(*map(F.lit, X.IGNORED_DIRECTORIES))) | base.isin(*X.IGNORED_FILENAMES) | base.rlike(suffixes)


def is_source(path: Column) -> Column:
    return extension_of(path).isin(*X.SOURCE_EXTENSIONS) | F.lower(basename_of(path)).isin(*X.SOURCE_FILENAMES)


def is_entry_point(path: Column) -> Column:
    return stem_of(path).isin(*X.ENTRY_POINT_NAMES)


def is_utility_dir(path: Column) -> Column:
    return F.lower(basename_of(path)).isin(*X.UTILITY_DIRS)


def file_kind(path: Column) -> Column:
    """go_mod, go_work, go_source, or null for all other files."""
    base = basename_of(F.replace(F.lower(path), F.lit("\\"), F.lit("/")))
    return F.when(base == "go.mod", "go_mod").when(base == "go.work", "go_work").when(base.endswith(".go"), "go_source")


def function_id(repo: Column, path: Column, name: Column) -> Column:
    return F.concat_ws("::", repo, path, name)
