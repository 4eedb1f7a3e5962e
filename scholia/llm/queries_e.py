"""Query of the operator 7, tested against all pairs on a small table."""

from __future__ import annotations

from scholia.llm import ngram_join


def op7_ngram_join(spark, sf_dir):
    return ngram_join.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {f.__name__: f for f in (op7_ngram_join,)}
ORACLE: dict[str, str] = {}
