"""A training-data pipeline over `documents`: quality rules, near-duplicate removal,
mixing to target weights, tokenising. Each stage is written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapidary.llm import bpe, common, mixing, quality, queries, similarity


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned list reject."""
    rules = quality.fit(docs, queries.table(spark, sf_dir, "labels"))
    return quality.judge(docs, rules).where("kept").select("row.*")


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the least id."""
    return similarity.one_of_each(docs, width=5, threshold=0.8)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at weights 5, 2, 1 in turn and 1.5 times all words: documents as often as taken,
    those in which a block ends once more with the words taken."""
    taken = mixing.mix(docs, weights=(5, 2, 1), share=1.5, most=2)
    return mixing.mixed_texts(taken).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts."""
    return bpe.token_digests(docs.select("doc_id", "source", "text"), queries.vocabulary())


STAGES = [
    ("quality_rules", good_quality),
    ("near_duplicates", without_near_duplicates),
    ("mixing", mixed),
    ("bpe", tokenised),
]
#: SQL can express neither the learned rules nor the tokeniser.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
