"""From raw documents to token digests: five stages, each on all that the one before kept.

``run`` writes each stage's rows as Parquet in the shared folder and reads them back, so a stage is planned
from real sizes and a lost executor costs only the running stage's tasks.

In every stage a null text counts as an empty one, rows repeated with one doc_id and text share a verdict, a null
doc_id is allowed, an empty table gives an empty one, other columns go through unread, and a very long text is a
text like any other. The stages' own docstrings say what that means for each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from maskora.llm import bpe_codec, decontaminate, exact_dedup, near_dedup, quality
from maskora.llm.shared import written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier rejects; empty texts get the score of no text."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id; empty texts are one group. A null doc_id stays only where its text has no other."""
    return exact_dedup.without_copies(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity of 0.8 or more), the document with the smallest doc_id.

    Texts without words and rows without doc_id are like nothing and stay.
    """
    return near_dedup.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark passage; texts without words hold none."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of the decoded text, for each document that is left; an empty text has no ids."""
    return bpe_codec.round_trip(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact),
    ("near-duplicate documents", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", byte_level_bpe),
]

#: Trained trees, minwise branching and the tokenizer have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
