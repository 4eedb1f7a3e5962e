"""Queries of the operators 4 and 8, and the SQL of those that SQL can express."""

from __future__ import annotations

from scholia.llm import mixing, quality_rules


def op4_quality_rules(spark, sf_dir):
    return quality_rules.judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_mixing(spark, sf_dir):
    return mixing.plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {f.__name__: f for f in (op4_quality_rules, op8_mixing)}
ORACLE: dict[str, str] = {}
