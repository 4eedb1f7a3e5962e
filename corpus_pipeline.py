"""A training-data pipeline of five operators: what each stage keeps is written and read by the next.

SQL can't express stages 3 to 5, so there is no SQL for the whole; the tests compare the whole
chain with plain Python versions of its stages.

Edge cases are those of the operators: null and empty texts fail the base quality rule and go in
the first stage; repeated rows are documents each until the third stage keeps one of a group;
other texts of one id are documents of their own; rows with a null id are linked with nothing and
stay; texts of any length are read whole; an empty table gives an empty result; all but the last
stage return all columns they get, whatever their names.
"""

from __future__ import annotations

import public_tokenizers

from pyspark.sql import DataFrame, SparkSession

from scholia.llm import bpe, line_dedup, mixing, ngram_join, quality_rules
from scholia.llm.common import Scratch, free_heaps


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the risk-controlled cutoffs of their language."""
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that five or more of them hold (the largest id keeps them)."""
    return line_dedup.dedup_documents(docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each component of near duplicates."""
    return ngram_join.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes, the last copy cut to the words taken."""
    free_heaps(spark)
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with digests of the ids and of what they decode to."""
    free_heaps(spark)
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", good_documents),
    ("line dedup", without_common_lines),
    ("n-gram Jaccard join", without_near_duplicates),
    ("mixing", mixed),
    ("byte-level BPE", encoded),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage on the documents table."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.cut(stage(spark, docs, sf_dir), f"stage-{i}")
    return STAGES[-1][1](spark, docs, sf_dir).drop("ids")
