"""Predicates of the graph queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def contains_ci(column: Column, text: Column | str) -> Column:
    """Case-insensitive substring."""
    return F.contains(F.lower(column), F.lower(text if isinstance(text, Column) else F.lit(text)))


def contains_any_ci(columns: Sequence[Column], text: Column | str) -> Column:
    """The substring in any of the columns; nulls hold nothing."""
    out = F.lit(False)
    for c in columns:
        out = out | contains_ci(F.coalesce(c, F.lit("")), text)
    return out


def in_repos(df: DataFrame, repos: Sequence[str] | None, column: str = "repo") -> DataFrame:
    """Only rows of the named repositories; all rows if none is named."""
    return df.where(F.col(column).isin(*repos)) if repos else df


def active_only(edges: DataFrame, on: bool) -> DataFrame:
    """Without soft-deleted edges, where asked for."""
    return edges.where(F.coalesce("is_active", F.lit(True))) if on else edges


def with_repo_hint(rows: DataFrame, hints: Column) -> DataFrame:
    """Subject rows, and rows whose repository or path holds a hint; all rows without hints."""
    low = F.concat_ws("\n", F.lower(F.coalesce("repo", F.lit(""))), F.lower(F.coalesce("filepath", F.lit(""))))
    return rows.where((F.size(hints) == 0) | F.col("rel_type").startswith("SUBJECT") | F.exists(hints, lambda h: F.contains(low, h)))
