"""Line dedup by a suffix array over line ids (operator 2), with DataFrame functions only.

Each document is the sequence of its non-blank lines. Distributed prefix
doubling ranks the suffixes: rank 0 orders single lines, and the rank at
level j + 1 orders the pairs (rank j here, rank j 2**j lines on), so that after
level j suffixes are sorted by their first 2**j lines. A suffix that shares them
with no other place is settled and leaves; only repeated text stays.

Suffixes with a common prefix of n lines are an interval of this order. Two
overlapping ranks of the level below n, at the run's start and before its end, name
the interval of a run of n lines, whatever n is. Runs are judged by words: each
place's shortest run of at least `MIN_WORDS` words, forwards and backwards, is looked
up, and what these cover is what all maximal runs that are long enough cover, as any
such run is the union of its shortest ones. The first place of an interval, by doc_id,
text hash and line, stays; the lines of its later copies are deleted, with blank
lines between them, so that overlapping copies join to maximal runs and go as a whole.

The first places of the most frequent intervals, `BROADCAST_RUNS` at most, are
broadcast; an interval that is not among them has only a small share of all places.

Words of a line are its runs of characters other than space, tab and carriage return.

Cases: a null text stays null, an empty one empty, both without lines; a null
doc_id comes before all others; rows equal in doc_id and text count as one
document and lose the same lines; ties between texts of one doc_id go by the
text's hash; extra columns pass through `dedup_lines` unread; an empty table
gives no rows. A text that loses all its lines becomes empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.plans.materialize import Scratch
from weftgraph.sources.tables import table

MIN_WORDS = 30
#: Documents with deletions that may be broadcast to the final pass; beyond it, a shuffled join does.
BROADCAST_DOCS = 200_000
#: Runs whose first places are broadcast: the most frequent ones of those at more places than `HOT`.
BROADCAST_RUNS = 100_000
HOT = 64
_NO_ID = -(2**63)
_BLANK = " \t\r"


#: Columns that deduplication adds.
_MADE = ("_weft_n_lines", "_weft_n_deleted", "_weft_has_text")


def _number(doc_id: Column) -> Column:
    """The doc_id, with null as the least number."""
    return F.coalesce(doc_id.cast("bigint"), F.lit(_NO_ID))


def _filled(line: Column) -> Column:
    return F.length(F.trim(line, F.lit(_BLANK))) > 0


def _reach(words: Column, at: Column, least: int, back: bool) -> Column:
    """Lines from place `at` (0-based) until `least` words are there; 0 if the document ends first."""
    if back:
        first = F.greatest(at - (least - 2), F.lit(1))
        part = F.reverse(F.slice(words, first, at + 2 - first))
    else:
        part = F.slice(words, at + 1, F.lit(least))
    start = F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(0).alias("n"))
    step = lambda acc, w: F.when(acc["sum"] >= least, acc).otherwise(F.struct((acc["sum"] + w).alias("sum"), (acc["n"] + 1).alias("n")))
    folded = F.aggregate(part, start, step)
    return F.when(F.get(words, at) >= least, F.lit(1)).otherwise(F.when(folded["sum"] >= least, folded["n"]).otherwise(F.lit(0)))


def _words(line: Column) -> Column:
    spaces = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit("")))
    odd = line.contains("\t") | line.contains("\r") | line.contains("  ") | line.startswith(" ") | line.endswith(" ")
    return F.when(odd, F.regexp_count(line, F.lit(f"[^{_BLANK}]+"))).otherwise(spaces + 1).cast("bigint")


def line_table(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """One row per non-blank line: d, h, pos, two hashes of the line, and how far its shortest runs reach."""
    lines = docs.where("text IS NOT NULL").select(_number(F.col("doc_id")).alias("_d"), F.xxhash64("text").alias("_h"), F.filter(F.split("text", "\n"), _filled).alias("lines"))
    counted = lines.select("_d", "_h", "lines", F.transform("lines", _words).alias("words"))
    entry = F.transform(
        "lines",
        lambda x, i: F.struct(F.xxhash64(x).alias("l1"), F.hash(x).alias("l2"), _reach(F.col("words"), i, least, False).alias("ahead"), _reach(F.col("words"), i, least, True).alias("behind")),
    )
    return counted.select("_d", "_h", F.posexplode(entry).alias("pos", "e")).select(F.col("_d").alias("d"), F.col("_h").alias("h"), "pos", "e.*")


PLACE = ("d", "h", "pos")


def _ranked(scratch: Scratch, rows: DataFrame, by: list[str], level: int) -> DataFrame:
    """The rows whose `by` stands at several places, with the rank of `by` in sorted order."""
    place = F.struct(*PLACE)
    classes = rows.groupBy(*by).agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select(*by)
    # Sorted over all partitions by a unique key, so the growing id is a rank, and a task run anew gives it again.
    ranks = classes.orderBy(*by).withColumn("rank", F.monotonically_increasing_id())
    out = rows.join(ranks, by).drop(*by)
    # Rows that repeat a document give its lines once more; from level 0 on, a place is there once.
    return scratch.put(out.dropDuplicates(list(PLACE)) if level == 0 else out, f"suffixes{level}")


def suffix_levels(scratch: Scratch, lines: DataFrame, least: int):
    """Yields (level, rows with d, h, pos, rank, ahead, behind): suffixes sorted by their first 2**level lines."""
    rows, level = _ranked(scratch, lines, ["l1", "l2"], 0), 0
    while True:
        yield level, rows
        step = 1 << level
        if 2 * step > least or rows.isEmpty():
            return
        there = F.first("rank").over(Window.partitionBy("d", "h").orderBy("pos").rangeBetween(step, step))
        pairs = rows.withColumn("next", there).where("next IS NOT NULL").withColumnRenamed("rank", "here")
        rows, level = _ranked(scratch, pairs, ["here", "next"], level + 1), level + 1


def _runs_of_level(rows: DataFrame, repeated: DataFrame, level: int) -> DataFrame:
    """The shortest runs of 2**level to 2**(level + 1) - 1 lines, each named by its length and two ranks.

    `repeated` has all repeated lines: a run that reaches back may end on one whose own suffix is settled.
    """
    low = 1 << level
    fits = lambda c: F.col(c).between(low, 2 * low - 1)
    ahead = rows.where(fits("ahead")).select(*PLACE, F.col("ahead").alias("n"), F.col("rank").alias("r1"))
    if level == 0:
        return ahead.withColumn("r2", F.col("r1"))  # a run of one line reaches as far back as ahead
    back = repeated.where(fits("behind")).select("d", "h", (F.col("pos") - F.col("behind") + 1).alias("pos"), F.col("behind").alias("n"))
    runs = ahead.unionByName(back.join(rows.select(*PLACE, F.col("rank").alias("r1")), list(PLACE)))
    tails = rows.select("d", "h", F.col("pos").alias("tail"), F.col("rank").alias("r2"))
    return runs.withColumn("tail", F.col("pos") + F.col("n") - low).join(tails, ["d", "h", "tail"]).drop("tail")


def _later(scratch: Scratch, found: DataFrame) -> DataFrame:
    """The runs without the first place of each."""
    named = ["n", "r1", "r2"]
    place = F.struct(*PLACE)
    first = found.groupBy(*named).agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("places")).where("first <> last").drop("last")
    first = scratch.put(first, "first")
    often = scratch.put(first.where(F.col("places") > HOT).orderBy(F.desc("places"), *named).limit(BROADCAST_RUNS).select(*named, F.col("first").alias("often")), "often")
    marked = found.join(F.broadcast(often), named, "left")
    by_broadcast = marked.where(F.col("often").isNotNull() & (place != F.col("often"))).drop("often")
    rest = marked.where("often IS NULL").drop("often")
    by_join = rest.join(first.select(*named, "first"), named).where(place != F.col("first")).drop("first")
    return by_broadcast.unionByName(by_join)


def later_copies(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """d, h and `runs`, the merged ranges (from, to) of non-blank lines that copy an earlier place."""
    scratch = Scratch(docs.sparkSession, "linededup")
    lines = scratch.put(line_table(docs, least), "lines")
    found = repeated = None
    for level, rows in suffix_levels(scratch, lines, least):
        repeated = rows if level == 0 else repeated
        part = _runs_of_level(rows, repeated, level)
        found = part if found is None else found.unionByName(part)
    found = scratch.put(found, "runs")
    named = ["n", "r1", "r2"]
    copies = _later(scratch, found).select(*PLACE, (F.col("pos") + F.col("n") - 1).alias("to"))
    order = Window.partitionBy("d", "h").orderBy("pos", "to")
    before = F.max("to").over(order.rowsBetween(Window.unboundedPreceding, -1))
    parts = copies.withColumn("new", F.coalesce((F.col("pos") > before + 1).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(order))
    merged = parts.groupBy("d", "h", "run").agg(F.min("pos").alias("from"), F.max("to").alias("to"))
    return scratch.put(merged.groupBy("d", "h").agg(F.sort_array(F.collect_list(F.struct("from", "to"))).alias("runs")), "copies")


def _dedup(docs: DataFrame, least: int) -> DataFrame:
    """The rows with `text` cleaned, beside _MADE: all lines of the text, deleted ones, and whether any text is left."""
    runs = later_copies(docs, least).select(F.col("d").alias("_weft_d"), F.col("h").alias("_weft_h"), F.col("runs").alias("_weft_runs"))
    few = runs.limit(BROADCAST_DOCS + 1).count() <= BROADCAST_DOCS
    key = (_number(F.col("doc_id")) == F.col("_weft_d")) & (F.xxhash64("text") == F.col("_weft_h"))
    joined = docs.join(F.broadcast(runs) if few else runs, key, "left")
    changed = F.col("_weft_runs").isNotNull()
    rows = joined.withColumn("_weft_new", F.when(changed, _without(F.col("text"), F.col("_weft_runs"))))
    n_lines = F.when(F.length("text") > 0, F.size(F.split("text", "\n"))).otherwise(0).cast("bigint")
    return rows.select(
        *(F.when(changed, F.col("_weft_new.text")).otherwise(F.col("text")).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns),
        n_lines.alias(_MADE[0]), F.when(changed, n_lines - F.col("_weft_new.n")).otherwise(0).cast("bigint").alias(_MADE[1]), F.coalesce("_weft_new.has_text", F.lit(True)).alias(_MADE[2]),
    )


def dedup_lines(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """The rows with `text` cleaned, and three columns, in the place of any so named: n_lines, n_deleted, has_text."""
    names = [m.removeprefix("_weft_") for m in _MADE]
    out = _dedup(docs, least).drop(*names)
    return out.withColumnsRenamed(dict(zip(_MADE, names, strict=True)))


def _let(value: Column, *steps) -> Column:
    """Applies the steps one after the other. Each one's input is bound as a lambda's variable, so it is computed once
    even where the optimiser moves the expression, and not once for each place that reads it."""
    box = F.array(value)
    for step in steps:
        box = F.transform(box, step)
    return F.get(box, 0)


def _without(text: Column, runs: Column) -> Column:
    """text, n (lines) and has_text of a text without the ranges of its non-blank lines."""

    def places(s: Column) -> Column:
        filled = F.filter(F.sequence(F.lit(0), F.size(s["lines"]) - 1), lambda i: _filled(F.get(s["lines"], i)))
        return F.struct(s["lines"].alias("lines"), s["runs"].alias("runs"), filled.alias("filled"))

    def gone(s: Column) -> Column:
        ranges = F.transform(s["runs"], lambda r: F.struct(F.get(s["filled"], r["from"]).alias("from"), F.get(s["filled"], r["to"]).alias("to")))
        return F.struct(s["lines"].alias("lines"), ranges.alias("gone"))

    def kept(s: Column) -> Column:
        # Between the deleted ranges lie the kept ones: from the end of the range before to the start of the next.
        start = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get(s["gone"], k - 1)["to"] + 1)
        stop = lambda k: F.coalesce(F.get(s["gone"], k)["from"], F.size(s["lines"]))
        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(s["gone"])), lambda k: F.slice(s["lines"], start(k) + 1, stop(k) - start(k))))

    def joined(lines: Column) -> Column:
        return F.struct(F.array_join(lines, "\n").alias("text"), F.size(lines).alias("n"), F.exists(lines, _filled).alias("has_text"))

    return _let(F.struct(F.split(text, "\n").alias("lines"), runs.alias("runs")), places, gone, kept, joined)


def clean_documents(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """The documents without repeated runs; those that only copied others go. `n_chars` follows the text."""
    out = _dedup(docs, least).where(F.col(_MADE[2]))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(_MADE[1]) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*(f"`{c}`" for c in docs.columns))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of the table with the later copies of repeated line runs deleted."""
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_deleted", "text")


ORACLE = f"""
WITH split AS (
  SELECT doc_id, text, CASE WHEN length(text) > 0 THEN string_split(text, chr(10)) ELSE [] END AS lines FROM documents
), numbered AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS ln FROM split
), filled AS (
  SELECT doc_id, line, ln, row_number() OVER (PARTITION BY doc_id ORDER BY ln) AS pos,
    len(regexp_extract_all(line, '[^ \\t\\r]+')) AS words
  FROM numbered WHERE length(trim(line, ' ' || chr(9) || chr(13))) > 0
), packed AS (
  SELECT doc_id, list(line ORDER BY pos) AS l, list(words ORDER BY pos) AS w FROM filled GROUP BY doc_id
), reach AS (
  SELECT f.doc_id, f.pos, p.l,
    (SELECT min(n) FROM range(1, {MIN_WORDS} + 1) r(n) WHERE f.pos + n - 1 <= len(p.w) AND list_sum(p.w[f.pos : f.pos + n - 1]) >= {MIN_WORDS}) AS ahead,
    (SELECT min(n) FROM range(1, {MIN_WORDS} + 1) r(n) WHERE f.pos - n + 1 >= 1 AND list_sum(p.w[f.pos - n + 1 : f.pos]) >= {MIN_WORDS}) AS behind
  FROM filled f JOIN packed p USING (doc_id)
), runs AS (
  SELECT doc_id, pos AS b, ahead AS n, l[pos : pos + ahead - 1] AS run FROM reach WHERE ahead IS NOT NULL
  UNION SELECT doc_id, pos - behind + 1, behind, l[pos - behind + 1 : pos] FROM reach WHERE behind IS NOT NULL
), ordered AS (
  SELECT doc_id, b, n, row_number() OVER (PARTITION BY run ORDER BY doc_id, b) AS copy FROM runs
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(b, b + n)) AS pos FROM ordered WHERE copy > 1
), places AS (
  SELECT g.doc_id, g.pos, f.ln, lag(g.pos) OVER w AS pos_before, lag(f.ln) OVER w AS ln_before
  FROM gone g JOIN filled f USING (doc_id, pos) WINDOW w AS (PARTITION BY g.doc_id ORDER BY g.pos)
), deleted AS (
  SELECT doc_id, list(ln) AS lns FROM (
    SELECT doc_id, ln FROM places
    UNION ALL SELECT doc_id, unnest(range(ln_before + 1, ln)) FROM places WHERE pos_before = pos - 1
  ) GROUP BY doc_id
)
SELECT s.doc_id, CAST(len(s.lines) AS BIGINT) AS n_lines, CAST(coalesce(len(d.lns), 0) AS BIGINT) AS n_deleted,
  CASE WHEN d.lns IS NULL THEN s.text ELSE
    coalesce(array_to_string([s.lines[i] FOR i IN range(1, len(s.lines) + 1) IF NOT list_contains(d.lns, i)], chr(10)), '') END AS text
FROM split s LEFT JOIN deleted d USING (doc_id)
"""
