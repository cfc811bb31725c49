"""From raw documents to encoded training text, in five stages.

A stage is a function of (spark, docs, sf_dir) to a DataFrame. What one returns is written as Parquet and read again as
the next one's documents, so each stage begins with a short lineage and lost executors cost one stage at most. All but the last return the
columns of ``documents``; the last adds the piece ids.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, jaccard, language, pieces, quality
from tessera.llm.common import bound_batches, cut, table

#: SQL cannot train the classifiers or encode text; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def bounded(stage: Callable) -> Callable:
    """The stage in a session of small Arrow batches, as its rows are only made when what it returns is written."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


@bounded
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


@bounded
def keep_told(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or without a likely language go."""
    return language.accepted(docs)


@bounded
def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of exact and near copies the document with the smallest doc_id stays."""
    return jaccard.representatives(docs)


@bounded
def keep_unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, whole or edited, go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


@bounded
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its piece ids and their number."""
    return pieces.with_ids(docs).withColumn("n_pieces", F.size("piece_ids"))


STAGES = [
    ("quality classifier", keep_good),
    ("language identification", keep_told),
    ("n-gram Jaccard join", keep_one),
    ("benchmark decontamination", keep_unleaked),
    ("piece encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
