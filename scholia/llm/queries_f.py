"""Query of the operator 1, tested against all windows of a small table."""

from __future__ import annotations

from scholia.llm import suffix_dedup


def op1_suffix_dedup(spark, sf_dir):
    return suffix_dedup.dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")


QUERIES = {f.__name__: f for f in (op1_suffix_dedup,)}
ORACLE: dict[str, str] = {}
