"""From documents to token ids: quality, line dedup, near-duplicates, benchmark decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. A row without a doc_id passes
the stages that compare documents; no stage needs other columns than doc_id and text, and all but the last keep every
column.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from assaysift.llm import bpe, decontaminate, lines, minhash, quality
from assaysift.session import reliable_checkpoint


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the classifier, fitted on this stage's own documents, rejects."""
    return quality.reject_low_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines of 40 code points or more that five documents or more share, except in the largest id."""
    return lines.drop_common_lines(docs, 40, 5)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of every group of documents linked by a similarity of 0.8 or more on five-word shingles."""
    return minhash.drop_near_duplicates(docs, 80, 100)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item, as it is or edited."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Return doc_id, n_tokens and digests of the ids and of the text that they decode to."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.round_trip_digests(spark, bpe.encode(docs, path), path)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("encoding", encoding_stage),
]

#: The classifier is fitted, which SQL cannot express. Tests hold the rows and texts of every later stage against brute force
#: on a fixture, and those of the first against the classifier's own verdicts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of ``sf_dir``, each written as Parquet and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = reliable_checkpoint(stage(spark, docs, sf_dir))
    return docs
