"""Diffs as tables: truncation, the compact diff, its text, hunks, added and removed lines, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph import schema as X
from weftgraph.functions.paths import is_noise


def blank_to_null(c: Column) -> Column:
    """'' read as missing, as the graph's writers treat it."""
    return F.nullif(c, F.lit(""))


def truncate(text: Column, limit: int = 5000) -> Column:
    """At most `limit` characters and a mark where any were cut; '' for null."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("\n... [truncated]"))).otherwise(F.coalesce(text, F.lit("")))


def author_of(login: Column, name: Column) -> Column:
    return F.coalesce(blank_to_null(login), blank_to_null(name), F.lit("unknown"))


def parse_iso(text: Column) -> Column:
    """A UTC instant written like 2024-01-31T12:00:00Z; null for anything else."""
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ssX"))


def within_window(text: Column, as_of: Column, days: int = X.DEEP_SCAN_DAYS) -> Column:
    return parse_iso(text) >= as_of - F.expr(f"INTERVAL {days} DAYS")


def compact_diff(files: DataFrame, max_files: int = X.DIFF_FILES, chars: int = X.PATCH_CHARS) -> DataFrame:
    """Per sha, the `max_files` files with most changes that are no noise and have a patch.

    files: sha, pos, filename, path, status, patch, additions, deletions, changes. Adds `rank` from 1.
    Patches are cut before the files are ranked, so whole ones never move between tasks.
    """
    named = files.withColumn("filename", F.coalesce(blank_to_null(F.col("filename")), blank_to_null(F.col("path")), F.lit("unknown"))).drop("path")
    kept = named.where(~is_noise(F.col("filename")) & (F.octet_length("patch") > 0)).withColumn("patch", truncate(F.col("patch"), chars))
    order = Window.partitionBy("sha").orderBy(F.coalesce("changes", F.lit(0)).desc(), "pos")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max_files)
    filled = {c: F.coalesce(c, F.lit(0)) for c in ("additions", "deletions", "changes")}
    return ranked.withColumns({"status": F.coalesce("status", F.lit("modified")), **filled})


def compact_files(details: DataFrame, max_files: int = X.DIFF_FILES, chars: int = X.PATCH_CHARS) -> DataFrame:
    """`compact_diff` of commits that hold their files as an array, as payloads do: within each row, so nothing moves.

    details: sha, files (as in the payloads).
    """

    def filled(f: Column, pos: Column) -> Column:
        name = F.coalesce(blank_to_null(f["filename"]), blank_to_null(f["path"]), F.lit("unknown"))
        number = lambda c: F.coalesce(f[c], F.lit(0)).alias(c)
        # In the order of the fields, the first two are the rank.
        return F.struct((-F.coalesce(f["changes"], F.lit(0))).alias("less"), pos.alias("pos"), name.alias("filename"), F.coalesce(f["status"], F.lit("modified")).alias("status"), f["patch"].alias("patch"), number("additions"), number("deletions"), number("changes"))

    kept = F.filter(F.transform("files", filled), lambda f: ~is_noise(f["filename"]) & (F.octet_length(f["patch"]) > 0))
    best = details.select("sha", F.slice(F.array_sort(kept), 1, max_files).alias("best"))
    rows = best.select("sha", F.posexplode("best").alias("rank", "f")).select("sha", (F.col("rank") + 1).alias("rank"), "f.*").drop("less")
    return rows.withColumn("patch", truncate(F.col("patch"), chars))


def diff_text(compact: DataFrame) -> DataFrame:
    """Per sha, the compact diff as one text, a section per file."""
    section = F.concat(
        F.lit("File: "), "filename", F.lit("\nStatus: "), "status", F.lit("\nAdditions: "), F.col("additions").cast("string"),
        F.lit("\nDeletions: "), F.col("deletions").cast("string"), F.lit("\nPatch:\n"), "patch",
    )
    ordered = F.array_sort(F.collect_list(F.struct("rank", section.alias("text"))))
    return compact.groupBy("sha").agg(F.array_join(F.transform(ordered, lambda s: s["text"]), "\n\n").alias("diff_text"))


def summaries(commits: DataFrame, compact: DataFrame) -> DataFrame:
    """Per sha, the offline summary: the message and the first files of the compact diff. commits: sha, repo, message."""
    entry = F.concat("filename", F.lit(" ("), "status", F.lit(", +"), F.col("additions").cast("string"), F.lit("/-"), F.col("deletions").cast("string"), F.lit(")"))
    listed = compact.groupBy("sha").agg(F.array_sort(F.collect_list(F.struct("rank", entry.alias("text")))).alias("files"))
    text = F.array_join(F.transform(F.slice("files", 1, X.SUMMARY_FILES), lambda s: s["text"]), ", ")
    more = F.when(F.size("files") > X.SUMMARY_FILES, F.concat(F.lit(" and "), (F.size("files") - X.SUMMARY_FILES).cast("string"), F.lit(" more"))).otherwise(F.lit(""))
    head = F.concat(F.lit("Commit in "), "repo", F.lit(": "))
    message = F.coalesce("message", F.lit(""))
    short = F.concat(head, F.substring(message, 1, 200))
    full = F.concat(head, F.substring(message, 1, 100), F.lit("\nKey files: "), text, more, F.lit("."))
    return commits.join(listed, "sha", "left").select("sha", F.when(F.col("files").isNull(), short).otherwise(full).alias("summary_text"))


#: Characters of a diff that a summary's prompt holds.
PROMPT_CHARS = 20_000


def prompts(commits: DataFrame, texts: DataFrame) -> DataFrame:
    """sha and the prompt of a summary: repository, message and the first part of the diff's text. texts: sha, diff_text."""
    parts = F.concat(
        F.lit("Summarise this commit in two or three sentences: what changes, where and why.\n\nRepository: "), "repo", F.lit("\nMessage: "), F.coalesce("message", F.lit("")),
        F.lit("\n\nDiff:\n"), F.substring(F.coalesce("diff_text", F.lit("")), 1, PROMPT_CHARS),
    )
    return commits.join(texts, "sha", "left").select("sha", parts.alias("prompt"))


def hunks(patches: DataFrame) -> DataFrame:
    """Per hunk header of a patch, the first line and number of lines on the new side. Empty hunks are left out."""
    lines = patches.select("sha", "path", F.explode(F.split("patch", "\n")).alias("line")).where(F.col("line").startswith("@@"))
    found = r"\+(\d+)(?:,(\d+))? @@"
    return (
        lines.where(F.col("line").rlike(found))
        .select("sha", "path", F.regexp_extract("line", found, 1).cast("int").alias("start"), F.coalesce(blank_to_null(F.regexp_extract("line", found, 2)), F.lit("1")).cast("int").alias("count"))
        .where("count > 0")
    )


def signed_lines(patches: DataFrame, keys: Sequence[str] = ("sha", "path")) -> DataFrame:
    """Added and removed lines of patches: keys, sign (+ or -), pos, line without its sign. patches: keys, patch."""
    lines = patches.select(*keys, F.posexplode(F.split("patch", "\n")).alias("pos", "raw"))
    added = F.col("raw").startswith("+") & ~F.col("raw").startswith("+++")
    removed = F.col("raw").startswith("-") & ~F.col("raw").startswith("---")
    return lines.where(added | removed).select(*keys, F.substring("raw", 1, 1).alias("sign"), "pos", F.expr("substring(raw, 2)").alias("line"))
