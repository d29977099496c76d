"""A training corpus from documents, in five stages. Each gets what the one
before kept, as a Parquet table; all but the last return documents' columns.

In every stage null texts count as empty, null ids and sources are values of
their own, repeated rows are rows like others (one stays after near_duplicates),
texts of any length are taken whole, further columns are carried along whatever
their names, and an empty table gives an empty one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import dartminhash, mixing, packing, quality, suffixdedup
from tidemark.llm.common import written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; an empty text has
    the score of no features."""
    return quality.kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that of the least id;
    texts without words are one class."""
    return dartminhash.deduplicated(docs)


def repeated_string_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 100-byte strings that also start earlier. One of
    which nothing remains goes; one that was empty stays."""
    return suffixdedup.cleaned(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's documents as often as the mix takes them: the largest share
    once, none more than 1.25 times on average."""
    return mixing.realised(docs, mixing.Params(max_repetition=1.25))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens, in the order of
    the mix; an empty text is its end id."""
    return packing.packed(docs)


STAGES = [
    ("quality_classifier", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeated_strings", repeated_string_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: No stage but the mixing's sums can be said in SQL; tests compare the stages
#: with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
