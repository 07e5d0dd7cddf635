"""From raw documents to encoded training text, stage by stage.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's documents. All stages but the last return the columns of ``documents``.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodegrid.llm import bpe, decontaminate, language, neardup, quality
from lodegrid.llm.queries import RANKS, fold, quality_labels, table
from lodegrid.session import scratch_path

#: A text is rejected where no language is found or the nearest is not the likelier one.
LEAST_LANGUAGE = 0.3
#: A text is rejected below this probability of good quality.
LEAST_QUALITY = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those without letters or between languages go."""
    model = language.learn(docs, fold(3) != 1)
    found = language.identify(docs, model)
    return found.where(f"lang_pred <> '{language.UNKNOWN}' AND lang_score >= {LEAST_LANGUAGE}").select(*docs.columns)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier holds for good."""
    scored = quality.score(docs, quality.learn(docs, quality_labels(spark, sf_dir)))
    return scored.where(f"quality_score >= {LEAST_QUALITY}").select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return neardup.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids."""
    return bpe.encode(docs, public_tokenizers.path(RANKS))


STAGES = [
    ("language", known_language), ("quality", good_quality), ("near_duplicates", one_of_each),
    ("decontamination", without_benchmark), ("encoding", encoded),
]

#: Models are learned and hashed in the stages, which SQL cannot express; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
