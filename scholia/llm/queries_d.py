"""Query of the operator 3. SQL has no positions of matches; tests compare it with plain Python."""

from __future__ import annotations

from scholia.llm import pii


def op3_pii(spark, sf_dir):
    return pii.find(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("entities")


QUERIES = {f.__name__: f for f in (op3_pii,)}
ORACLE: dict[str, str] = {}
