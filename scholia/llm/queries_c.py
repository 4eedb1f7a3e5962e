"""Queries of the operators 5 and 9, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholia.llm import line_dedup, vector_search


def op5_line_dedup(spark, sf_dir):
    return line_dedup.dedup_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op9_vector_search(spark, sf_dir):
    return vector_search.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 100 == 0)


OP5_SQL = r"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM docs),
keyed AS (SELECT doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
often AS (SELECT key, max(doc_id) AS keep FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
judged AS (SELECT k.*, o.key IS NOT NULL AND k.doc_id <> o.keep AS gone FROM keyed k LEFT JOIN often o ON k.key = o.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

QUERIES = {f.__name__: f for f in (op5_line_dedup, op9_vector_search)}
ORACLE = {"op5_line_dedup": OP5_SQL}
