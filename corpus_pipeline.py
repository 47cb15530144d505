"""From raw documents to packed windows: five operators of tessera.llm, one after the other.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, with the columns of ``documents``; the last
returns the pieces of packed windows. Between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, jaccard, mixing, packing, quality
from tessera.llm.common import table

#: Documents whose quality score is lower go.
THRESHOLD = 0.7


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    trees = quality.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    score = "__score" + "_" * max(map(len, docs.columns))  # a name that no column has
    return quality.score_rows(docs, trees, score_col=score).filter(F.col(score) >= THRESHOLD).drop(score)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_rows(docs)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one_text(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("jaccard", jaccard_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Boosted trees and the tokenizer have no SQL; tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="tessera-pipeline-")
    folder = f"{shared}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
