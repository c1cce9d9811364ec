"""A training-data pipeline of five operators: what it keeps of ``documents``, packed.

Each stage gets the rows that the one before kept and returns rows with the same
columns; the last returns the pieces of packed sequences.  Between stages the rows are
written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from concordance.llm.common import staged, table
from concordance.llm.languages import in_a_language
from concordance.llm.mixing import mixed
from concordance.llm.packing import pack
from concordance.llm.queries import held_out, tokenizer_path
from concordance.llm.shingles import without_similar
from concordance.llm.toxicity import not_toxic


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages stay."""
    return in_a_language(docs, docs.filter(~held_out(4, 2)))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model predicts as ordinary stay."""
    return not_toxic(docs, docs.filter(~held_out(5, 0)), table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents that share 80 % of their five-word shingles the one with the least id stays."""
    return without_similar(docs, shingle=5, least=0.8)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents replicated to the square-root weights of their sources, shuffled."""
    return mixed(docs, temperature=0.5, seed="mix")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of full sequences of 2048 tokens."""
    return pack(docs, tokenizer_path("byte_bpe_50k.json"), end_id=1)


STAGES = [("language", language), ("toxicity", toxicity), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: Cross-parsing, language models and tokenizers can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
