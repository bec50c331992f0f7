"""A corpus pipeline of five stages, each one operator of weftgraph.llm.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept,
and its result is written as Parquet and reread as the next one's docs. All but
the last return the columns of documents; the last returns encoded rows.

    toxicity        rejects documents that score 0.7 or more
    line_dedup      deletes later copies of repeated line runs; a document that held nothing else goes
    near_dedup      keeps the least doc_id of each group of near copies (five-word shingles, 0.8)
    decontaminate   drops documents that leak a benchmark item
    sentencepiece   encodes the texts: doc_id, ids, n_pieces, round_trip

Null, empty and repeated rows are treated as each operator's module says. An
empty table passes through all stages as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import decontaminate, linededup, neardup, sentencepieces, toxicity
from weftgraph.plans.materialize import Scratch
from weftgraph.sources.tables import table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(spark, docs, table(spark, sf_dir, "labels"))


def delete_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.clean_documents(docs)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.drop_near_duplicates(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(spark, docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepieces.encode_documents(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", delete_repeated_lines),
    ("near_dedup", keep_one_of_near_copies),
    ("decontaminate", drop_benchmark_leaks),
    ("sentencepiece", encode),
]

#: Learnt scores, string tiling and tokenizer merges are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`, each through a written table in the shared folder."""
    scratch, docs, before = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        start = Scratch.mark()
        docs = scratch.put(stage(spark, docs, sf_dir), name)
        # The stage's own tables and its input are read no more.
        Scratch.release(start)
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs
