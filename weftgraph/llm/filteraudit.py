"""What quality filters remove together and apart, exactly, in all their orders (operator 12).

Five conditions are judged per document, whose failures are a mask of five bits;
the masks are counted by part, as are those of good and of toxic documents. From
the counts of a part its removal polynomial is formed: the multilinear extension of
"documents removed by a set of filters", with a coefficient for each set. Its value
at a corner is what a set removes, so corners give the survivors of every order and
step. A filter's Shapley value is the integral of the partial derivative along the
cube's diagonal, taken with exact rationals; times 120 it is what the filter removes,
summed over all orders.

    A  fewer than 200 words                     B  100 * distinct words < 50 * words
    C  100 * characters A-Z > 3 * code points   D  holds any of # $ % & * |
    E  equal to the text of a smaller doc_id anywhere in the table

Texts are told apart by their SHA-256. The least id of a text is an aggregate with
partial sums, and a text's rows meet it in a join that adaptive execution splits. What
reaches one task for a part is 32 counts at most.

Cases: a null text is empty, which fails A alone (and E); a null lang is the part '';
a null doc_id is neither smaller nor greater than another, so it passes E; rows equal in
doc_id and text don't make each other fail E; a document is good (toxic) if any of its
labels says so, and labels of a null doc_id belong to none; extra columns are not read;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import by_size, column
from weftgraph.plans.materialize import Scratch
from weftgraph.sources.tables import table

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_UPPER = 200, 50, 3
_UPPER = bytes(range(65, 91))
_MARKS = b"#$%&*|"
#: Bytes of text that a task holds at once.
BLOCK_BYTES = 8 << 20
ALL = (1 << len(FILTERS)) - 1


def failures(text: str) -> int:
    """The mask of A to D that a text fails; A is bit 0."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    upper = len(raw) - len(raw.translate(None, _UPPER))
    return (
        (len(words) < LEAST_WORDS) | (100 * len(set(words)) < LEAST_DISTINCT * len(words)) << 1 | (100 * upper > MOST_UPPER * len(text)) << 2 | (len(raw.translate(None, _MARKS)) < len(raw)) << 3
    )


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in by_size(batches, "text", BLOCK_BYTES):
        texts = column(part, "text")
        out = [part.column(0), part.column(2), pa.array([failures(t) for t in texts], pa.int32()), pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() for t in texts], pa.binary())]
        yield pa.RecordBatch.from_arrays(out, ["id", "part", "mask", "digest"])


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """id, part and mask of every row: the filters that it fails, E included."""
    scratch = Scratch(docs.sparkSession, "filters")
    plain = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(part_col), F.lit("")).alias("part"))
    judged = scratch.put(plain.mapInArrow(_judge, "id bigint, part string, mask int, digest binary"), "judged")
    least = judged.groupBy("digest").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("digest", "least")
    # Written, so that the join's sides are plain shuffles, which a skewed join can split.
    rows = judged.join(scratch.put(least, "repeated"), "digest", "left")
    return rows.select("id", "part", F.when(F.col("id") > F.col("least"), F.col("mask").bitwiseOR(F.lit(16))).otherwise(F.col("mask")).alias("mask"))


def counts(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents by what they fail. labels: doc_id, quality, toxic."""
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("bad"))
    total = lambda c: F.sum(F.coalesce(c, F.lit(0))).cast("bigint")
    return masked.join(known, "id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), total("good").alias("good"), total("bad").alias("toxic"))


class Removal:
    """The multilinear extension of what sets of filters remove, from counts by mask."""

    def __init__(self, by_mask: dict[int, int]) -> None:
        self.total = sum(by_mask.values())
        # A document of mask m is removed unless each filter of m is off: n * (1 - prod(1 - x_i)), multiplied out.
        self.terms = [0] * (ALL + 1)
        for mask, n in by_mask.items():
            part = mask
            while part:
                self.terms[part] -= n * (-1) ** part.bit_count()
                part = (part - 1) & mask

    def at(self, chosen: int) -> int:
        """The value at a corner: documents that the chosen filters remove."""
        part, out = chosen, 0
        while part:
            out += self.terms[part]
            part = (part - 1) & chosen
        return out

    def shapley(self, k: int) -> Fraction:
        """The integral over t in 0..1 of the k-th partial derivative at (t, ..., t): t**(size - 1) gives 1 / size."""
        return sum((Fraction(c, part.bit_count()) for part, c in enumerate(self.terms) if part >> k & 1), Fraction(0))


_REPORT = "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"


def report(rows: pd.DataFrame) -> pd.DataFrame:
    """All orders and steps of one part, from its counts."""
    every, good, toxic = (Removal(dict(zip(rows["mask"].tolist(), rows[c].tolist(), strict=True))) for c in ("n", "good", "toxic"))
    part, out = rows["part"].iloc[0], []
    share = [int(120 * every.shapley(k)) for k in range(len(FILTERS))]
    alone = [every.at(ALL) - every.at(ALL ^ 1 << k) for k in range(len(FILTERS))]
    for order in permutations(range(len(FILTERS))):
        name, before = "".join(FILTERS[k] for k in order), 0
        for step, k in enumerate(order, 1):
            now = before | 1 << k
            removed = every.at(now) - every.at(before)
            out.append((part, name, step, every.total - every.at(now), removed, every.at(1 << k) - removed, alone[k], good.at(now) - good.at(before), toxic.at(now) - toxic.at(before), share[k]))
            before = now
    return pd.DataFrame(out, columns=[x.split()[0] for x in _REPORT.split(", ")])


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """A row per part, order and step: what is kept and removed there, and the filter's Shapley value times 120."""
    return counts(masks(docs, id_col, text_col, part_col), labels).groupBy("part").applyInPandas(report, _REPORT)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents of the table, by language."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE = r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents
), cut AS (
  SELECT *, [x FOR x IN string_split_regex(t, '[\x20\x09-\x0D]+') IF x <> ''] AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM texts
), known AS (
  SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS bad FROM labels GROUP BY doc_id
), judged AS (
  SELECT part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > least, false) AS e,
    coalesce(good, 0) AS good, coalesce(bad, 0) AS bad
  FROM cut LEFT JOIN known USING (doc_id)
), masks AS (
  SELECT part, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END) || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS fails,
    count(*) AS n, sum(good) AS good, sum(bad) AS bad
  FROM judged GROUP BY ALL
), letters(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')
), orders AS (
  SELECT p.x || q.x || r.x || s.x || u.x AS o FROM letters p, letters q, letters r, letters s, letters u
  WHERE p.x NOT IN (q.x, r.x, s.x, u.x) AND q.x NOT IN (r.x, s.x, u.x) AND r.x NOT IN (s.x, u.x) AND s.x <> u.x
), steps AS (
  SELECT o, CAST(k AS INT) AS step, o[k] AS f, left(o, k - 1) AS done FROM orders, range(1, 6) t(k)
), met AS (
  SELECT part, o, step, f, n, good, bad, fails, contains(fails, f) AS here, length(translate(fails, done, '')) < length(fails) AS gone
  FROM masks, steps
), told AS (
  SELECT part, o, step, f, coalesce(sum(n) FILTER (NOT here AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (here AND NOT gone), 0) AS removed,
    coalesce(sum(n) FILTER (here AND gone), 0) AS redundant, coalesce(sum(n) FILTER (fails = f), 0) AS unique_fails,
    coalesce(sum(good) FILTER (here AND NOT gone), 0) AS good_lost, coalesce(sum(bad) FILTER (here AND NOT gone), 0) AS toxic_lost
  FROM met GROUP BY ALL
)
SELECT part, o AS filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM told
"""
