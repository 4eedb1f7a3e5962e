"""Queries of the operators 2, 6 and 10, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers

from scholia.llm import bpe, sharding, url_filter

SHARDS = 40
#: The entries (verdict, host, path).
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op2_sharding(spark, sf_dir):
    return sharding.assign(spark.read.parquet(f"{sf_dir}/documents.parquet"), [1.0] * SHARDS)


def op6_url_filter(spark, sf_dir):
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES)


def op10_bpe(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


OP6_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END AS rest FROM pages),
p AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
r(verdict, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
m AS (SELECT page_id, r.h || r.p AS rule, r.verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(r.h || r.p) DESC) AS n
      FROM p JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.p))
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM p LEFT JOIN m ON p.page_id = m.page_id AND m.n = 1
"""

QUERIES = {f.__name__: f for f in (op2_sharding, op6_url_filter, op10_bpe)}
ORACLE = {"op6_url_filter": OP6_SQL}
