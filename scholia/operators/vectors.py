"""Exact vector search: blocks of vectors against the query set, multiplied in Arrow batches.

A query set stated by the caller is matched against all rows block by block; each block keeps only
its k best for a query, so what is shuffled is k rows for each block and query. Query sets above
``MAX_QUERIES`` rows are cut into tiles that meet the blocks one after another.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_QUERIES, TILE_ROWS = 20_000, 2048


def cosine(a: Column, b: Column) -> Column:
    """VEC1: cosine similarity by built-in functions, in double precision."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def similarity(cos: Column, metric: str = "cosine") -> Column:
    """Cosine similarity, or for ``l2sq`` one minus the squared distance of unit vectors: 2 cos - 1."""
    return cos if metric == "cosine" else 2 * cos - 1


def search_one(rows: DataFrame, query: list[float], k: int, where: Column | None = None, id_col: str = "id", vector_col: str = "v") -> DataFrame:
    """VEC1/VEC3: the k rows most similar to one vector, ties to the smaller id; a top-k without a full sort."""
    rows = rows if where is None else rows.where(where)
    q = F.array(*[F.lit(float(x)) for x in query])
    return rows.select(id_col, cosine(F.col(vector_col), q).alias("similarity")).orderBy(F.desc("similarity"), id_col).limit(k)


def nearest(rows: DataFrame, queries: DataFrame, k: int, exclude_self: bool = True) -> DataFrame:
    """VEC2/JON12: ``query, id, similarity, rank``: for each of ``queries(id, v)`` the k most similar of ``rows(id, v)``.

    Null, empty and zero vectors have no direction and take no part.
    """
    spark = rows.sparkSession
    rows, queries = (x.where(F.exists("v", lambda c: c != 0)) for x in (rows, queries))
    n = queries.count()
    tiles = max(1, -(-n // MAX_QUERIES))
    found = None
    for t in range(tiles):
        part = queries if tiles == 1 else queries.where(F.pmod(F.xxhash64("id"), F.lit(tiles)) == t)
        held = part.select("id", "v").collect()  # MAX_QUERIES vectors, about
        if not held:
            continue
        qid = np.array([r.id for r in held])
        qv = np.array([r.v for r in held], np.float64)
        qv /= np.maximum(np.linalg.norm(qv, axis=1, keepdims=True), 1e-300)
        shared = spark.sparkContext.broadcast((qid, qv))

        def run(batches, shared=shared):
            ids, q = shared.value
            for b in batches:
                x = np.array(b.column("v").to_pylist(), np.float64)
                if not len(x):
                    continue
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                own = b.column("id").to_numpy()
                out_q, out_i, out_s = [], [], []
                for s in range(0, len(q), TILE_ROWS):
                    sim = q[s : s + TILE_ROWS] @ x.T
                    if exclude_self:
                        sim[ids[s : s + TILE_ROWS, None] == own[None]] = -np.inf
                    m = min(k, sim.shape[1])
                    kth = np.partition(sim, sim.shape[1] - m, 1)[:, sim.shape[1] - m]
                    a, c = np.nonzero((sim >= kth[:, None] - 1e-12) & np.isfinite(sim))
                    out_q.append(ids[s + a])
                    out_i.append(own[c])
                    out_s.append(sim[a, c])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_q)), pa.array(np.concatenate(out_i)), pa.array(np.concatenate(out_s))], ["query", "id", "similarity"])

        kind = rows.schema["id"].dataType.simpleString()
        got = rows.select("id", "v").mapInArrow(run, f"query {kind}, id {kind}, similarity double")
        found = got if found is None else found.unionByName(got)
    if found is None:
        return rows.select(F.col("id").alias("query"), "id", F.lit(0.0).alias("similarity"), F.lit(0).alias("rank")).limit(0)
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def auto_links(found: DataFrame, threshold: float = 0.6, max_links: int = 5) -> DataFrame:
    """VEC4/TOP10: of the candidates fetched (min(3 * max_links, 50)), those similar enough, the best ``max_links``."""
    fetched = found.where(F.col("rank") <= min(3 * max_links, 50)).where(F.col("similarity") >= threshold)
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), "id")
    return fetched.withColumn("link", F.row_number().over(w)).where(F.col("link") <= max_links).select("query", "id", "similarity", "link")


def retrieval_metrics(ranked: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """AGG20: recall@k, precision@k (over k) and reciprocal rank of ``ranked(query, id, rank)`` against ``truth(query, id)``."""
    hits = ranked.join(truth.withColumn("hit", F.lit(True)), ["query", "id"], "left")
    per = hits.groupBy("query").agg(F.count_if(F.col("hit") & (F.col("rank") <= k)).alias("found"), F.coalesce(1.0 / F.min(F.when(F.col("hit"), F.col("rank"))), F.lit(0.0)).alias("rr"))
    size = truth.groupBy("query").agg(F.count("*").alias("relevant"))
    return size.join(per, "query", "left").select("query", F.coalesce(F.col("found") / F.col("relevant"), F.lit(0.0)).alias("recall"), F.coalesce(F.col("found") / F.lit(k), F.lit(0.0)).alias("precision"), F.coalesce("rr", F.lit(0.0)).alias("rr"))
