"""The whole pipeline against its stages in plain Python."""

from __future__ import annotations

import hashlib
import re

import brute
import conftest
import corpus_pipeline
import public_tokenizers
import pytest
import tiktoken
from test_operators import python_mix

from scholia.llm import bpe

LABELS = "doc_id long, quality int, toxic int"


def python_pipeline(rows):
    """Sorted (doc_id, n_tokens, ids_sha256, decoded_sha256) of (doc_id, text, lang, source) rows, where no cutoff is certified."""
    rows = [r for r in rows if (w := brute.quality(r[1]))[0] >= 50 and 100 * w[4] <= 50 * w[0]]
    rows = [(i, text, lang, source) for (i, _, lang, source), (_, _, text) in zip(rows, brute.lines_kept([r[:2] for r in rows]))]
    near = brute.near_components([r[:2] for r in rows])
    rows = [r for r in rows if near[r[0]][1] == r[0]]
    mixed = python_mix(rows, 16)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    out = []
    for i, text, _, _ in rows:
        taken, shards = mixed[i]
        n = len(brute.words(text))
        for copy in range(len(shards)):
            left = taken - copy * n
            own = text if left >= n else "".join(re.findall(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", text)[:left])
            ids = enc.encode_ordinary(own)
            out.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(own.encode()).hexdigest()))
    return sorted(out)


def tables(spark, path, rows, labels):
    spark.createDataFrame(rows, conftest.SCHEMA).selectExpr("*", "1 AS id", "2 AS n", "3 AS shard").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.mark.parametrize("seed", [5, 21])
def test_pipeline(spark, tmp_path, seed):
    rows = conftest.make_documents(seed, 110)
    got = corpus_pipeline.run(spark, tables(spark, tmp_path, rows, [(r[0], 1, 0) for r in rows[:5]])).collect()
    want = python_pipeline(rows)
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert 20 < len({x[0] for x in want}) < len(rows) - 20 and len(want) > len({x[0] for x in want})


def test_pipeline_columns_and_empty_tables(spark, tmp_path):
    sf = tables(spark, tmp_path, [], [])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_pipeline_repeated_and_null_ids(spark, tmp_path):
    """Equal rows are one group; a null id is linked with nothing; another text of the same id is a document of its own."""
    a, b = (" ".join(f"{c}{i}" for i in range(70)) for c in "vw")
    rows = [(4, a, "en", "s"), (4, a, "en", "s"), (4, b, "en", "s"), (None, a, "en", "s"), (9, a + " end", None, "s"), (7, None, None, None), (8, "", "en", None)]
    got = corpus_pipeline.run(spark, tables(spark, tmp_path, rows, [])).collect()
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted((r.doc_id or 0, r.decoded_sha256) for r in got) == sorted([(0, digest(a)), (4, digest(a)), (4, digest(b))])
