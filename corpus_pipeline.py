"""From raw documents to packed training sequences, stage by stage.

Every stage takes (spark, docs, sf_dir) and works on all rows it is given; its
result is written as Parquet and read again for the next stage.  All stages
but the last return the columns of ``docs``.  Columns besides doc_id and text
are carried under neutral names, so no name clashes with an operator's.

Nulls, empty and very long texts, ties and repeated rows are handled as each
operator's module says; an empty table passes through as an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trenchline.llm.common import MADE, drop_made, landed, table
from trenchline.llm.decision_list import quality_verdicts
from trenchline.llm.doubling_dedup import remove_repeats
from trenchline.llm.jaccard_join import keep_one
from trenchline.llm.packing import pack
from trenchline.llm.toxic_crf import toxicity


def _sheltered(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run ``stage`` with all other columns renamed, and give back the columns of ``docs``."""
    other = {c: f"_carried_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    out = stage(docs.withColumnsRenamed(other))
    return out.select([F.col(other.get(c, c)).alias(c) for c in docs.columns])


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores 0.5 or more go."""
    labels = table(spark, sf_dir, "labels")
    return _sheltered(docs, lambda d: toxicity(d, labels).where("toxic_score < 0.5"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base or a learned rule rejects go."""
    labels = table(spark, sf_dir, "labels")
    return _sheltered(docs, lambda d: quality_verdicts(d, labels).where("kept"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays (five-word shingles, Jaccard 0.8)."""
    return _sheltered(docs, keep_one)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows of 35 words that occur twice go; texts without any stay as they are.

    A text that loses words becomes its kept words joined by one space, and
    n_chars, where there is such a column, the new length."""

    def stage(d: DataFrame) -> DataFrame:
        out = remove_repeats(d)
        return out.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text")))

    out = _sheltered(docs, stage)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(kind))
    return out


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All texts as token pieces in sequences of at most 4096 tokens."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("quality_rules", quality_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("substring_dedup", repeats_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the learned stages nor the tokenizer; tests/llm/test_pipeline.py holds the brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage has landed on its way goes when its result is written."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        before = len(MADE)
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        docs = landed(out, f"pipeline_{name}")
        # the stage's own folders and the result of the stage before it, but not this one
        drop_made(spark, max(0, before - (i > 0)), len(MADE) - 1)
    return docs
