"""A corpus made ready for training: STAGES, each a call of an operator of grantloom.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grantloom.llm import mixing, near_dup, packing, substring, toxicity
from grantloom.llm.common import id_remainder, saved, table
from grantloom.llm.queries import MIX_WEIGHTS, TOXICITY_FOLDS, vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects go; it learns from labels outside the held-out fold."""
    learnt = id_remainder(F.col("doc_id"), TOXICITY_FOLDS) != 0
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"), learnt)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents with five-word shingles at a similarity of 0.8 or more, the smallest id stays."""
    return near_dup.without_near_duplicates(docs, shingle=5, percent=80)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in 50-word windows that an earlier document has go."""
    return substring.without_repeated_passages(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in the shares of their weights; a small source's documents come up to twice."""
    return mixing.mixed_documents(docs, MIX_WEIGHTS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of 2048 tokens."""
    return packing.pack(docs, vocabulary(), capacity=2048, end_id=0)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can't express the stages; the tests hold each of them against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; each one's result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
