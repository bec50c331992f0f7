"""Text blocks of retrieved rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.patches import blank_to_null

# The texts of the blocks below, here and in their functions.
RULE = "\n" + "─" * 60


def mark_hit_lines(code: Column, term: Column) -> Column:
    """Every line indented by four, those that hold the term marked; unchanged if none does."""
    low = F.lower(term)
    lines = F.split(F.regexp_replace(code, r"(\r\n|[\n\r\x0B\f\x1c-\x1e\x85  ])$", ""), r"\r\n|[\n\r\x0B\f\x1c-\x1e\x85  ]")
    marked = F.array_join(F.transform(lines, lambda x: F.concat(F.when(F.contains(F.lower(x), low), F.lit(">>> ")).otherwise(F.lit("    ")), x)), "\n")
    return F.when((F.length(code) > 0) & (F.length(term) > 0) & F.exists(lines, lambda x: F.contains(F.lower(x), low)), marked).otherwise(F.coalesce(code, F.lit("")))


def _line(label: str, value: Column) -> Column:
    """A labelled line, or null where the value is missing, so that concat_ws leaves it out."""
    return F.when(F.length(value) > 0, F.concat(F.lit(label), value))


def context_block(rows: DataFrame, keys: list[str], source: Column | None = None, allow_no_code: bool | Column = False) -> DataFrame:
    """One text per group of `keys`, its records in the order of `ord`; a path and name is shown once.

    A called node is shown below its record unless a record or call shown earlier had it.
    """
    allowed = allow_no_code if isinstance(allow_no_code, Column) else F.lit(allow_no_code)
    name = F.coalesce(blank_to_null(F.col("name")), blank_to_null(F.col("func_name")), F.lit("<unknown>"))
    path = F.coalesce(blank_to_null(F.col("filepath")), F.lit("<unknown path>"))
    code = F.trim(F.coalesce("code", F.lit("")), F.lit(" \t\n\r\x0b\f"))
    seeds = rows.select(*keys, "ord", name.alias("name"), path.alias("filepath"), code.alias("code"), "repo", "rel_type", "connected", F.lit(0).alias("sub"), (source if source is not None else F.col("source")).alias("source"))
    calls = seeds.select(*keys, "ord", "source", F.posexplode("connected").alias("k", "c")).select(
        *keys, "ord", "source", F.coalesce(blank_to_null(F.col("c.name")), F.lit("<unknown>")).alias("name"), F.coalesce("c.path", F.lit("")).alias("filepath"),
        F.trim(F.coalesce("c.code", F.lit("")), F.lit(" \t\n\r\x0b\f")).alias("code"), (F.col("k") + 1).alias("sub"),
    )
    seeds = seeds.drop("connected").where((F.length("code") > 0) | allowed)
    # Calls of a record that was itself seen before are not shown.
    first = Window.partitionBy(*keys, "filepath", "name").orderBy("ord", "sub")
    both = seeds.unionByName(calls.where(F.length("code") > 0), allowMissingColumns=True)
    shown_seed = seeds.withColumn("n", F.row_number().over(Window.partitionBy(*keys, "filepath", "name").orderBy("ord"))).where("n = 1").select(*keys, "ord")
    shown = both.join(shown_seed, [*keys, "ord"], "left_semi").withColumn("n", F.row_number().over(first)).where("n = 1")
    head = F.concat_ws(
        "\n", F.lit(RULE), F.concat(F.lit("Function : "), "name"), F.concat(F.lit("File     : "), "filepath"), _line("Repo     : ", F.col("repo")), _line("Relation : ", F.col("rel_type")),
        F.when(F.length("code") > 0, F.concat(F.lit("Code     :\n"), "code")).otherwise(F.lit("Code     : <not stored — structural reference only>")),
    )
    call = F.concat(F.lit("\n  ↳ Called/Dep: "), "name", F.lit("  ["), "filepath", F.lit("]\n  "), F.replace("code", F.lit("\n"), F.lit("\n  ")))
    return _joined(shown.withColumn("text", F.when(F.col("sub") == 0, head).otherwise(call)), keys)


def _joined(shown: DataFrame, keys: list[str]) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("ord", "sub", "text")))
    text = F.array_join(F.transform(ordered, lambda t: t["text"]), "\n")
    return shown.groupBy(*keys).agg(F.concat(F.lit("[Source: "), F.min("source"), F.lit("]\n"), text).alias("block"))


def blame_block(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One text per group of `keys`: who changed what, a commit, file and function once. An empty message stays empty."""
    message = F.element_at(F.split(F.trim(F.coalesce("commit_msg", F.lit("")), F.lit(" \t\n\r")), r"\R"), 1)
    filled = rows.select(
        *keys, "ord", F.lit(0).alias("sub"), F.lit("blame-traversal").alias("source"), F.coalesce(blank_to_null(F.col("author")), F.lit("<unknown>")).alias("author"),
        F.coalesce(blank_to_null(F.col("commit_sha")), F.lit("<no sha>")).alias("sha"), message.alias("message"), F.coalesce("committed_at", F.lit("")).alias("date"),
        F.coalesce("func_name", F.lit("")).alias("func_name"), F.coalesce(blank_to_null(F.col("filepath")), F.lit("<unknown path>")).alias("filepath"),
    )
    once = filled.withColumn("n", F.row_number().over(Window.partitionBy(*keys, "sha", "filepath", "func_name").orderBy("ord"))).where("n = 1")
    text = F.concat_ws(
        "\n", F.lit(RULE), F.concat(F.lit("Author     : "), "author"), F.concat(F.lit("Commit SHA : "), "sha"), F.concat(F.lit("Date       : "), "date"), F.concat(F.lit("Message    : "), "message"),
        _line("Function   : ", F.col("func_name")), F.concat(F.lit("File       : "), "filepath"),
    )
    return _joined(once.withColumn("text", text), keys)
