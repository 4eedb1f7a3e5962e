"""Operator 9: approximate nearest neighbours over balanced posting lists.

Centroids are fitted on a bounded sample (``SAMPLE`` distinct vectors, the smallest by hash) by
k-means with a price on long lists. Every vector goes to its nearest centroid and, near a
boundary, to further ones: those within ``(1 + spread)`` times the least distance, unless a
centroid already taken is nearer to them than the vector is (at most ``REPLICAS``). Centroids are
found by best-first search in a graph in memory: near neighbours of each and a few far links.
A query reads all lists whose centroids lie within ``(1 + reach)`` times its least distance, at
least ``MIN_LISTS``, and further ones until they hold enough rows. ``reach`` is widened to what
``HELD_OUT`` vectors outside the sample need to find ``RECALL`` of their true neighbours in the
whole table, so the number of lists read grows with their number where the vectors ask for it; on
vectors without structure that is nearly a full scan. Distances to what the lists hold are then
exact, in double precision.

Scale: all vectors are indexed. Up to ``GROUP`` near lists make a group, and a query and an entry
are sent once to each group, not once to each list. Equal vectors are one entry with their smallest ids (no more can
come first), found by a window that is pre-limited on the map side, so a vector held by a third
of all rows is a few rows for each task. Groups and queries meet in tiles of at most about
``TILE`` entries by ``TILE`` queries. What is broadcast are the centroids and their graph.

Edge cases: vectors that are null, empty, zero, of another length than most, or hold a null or
non-finite component take no part, nor do null ids; rows equal in id and vector are one; a row with
the query's id is not a candidate of it; fewer than k candidates are all returned; no vectors give
no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholia.llm.common import Scratch, ship

SAMPLE, LIST_ROWS, MAX_CENTROIDS = 20_000, 100, 4096
REPLICAS, DEGREE, FAR_LINKS, ENTRIES = 8, 16, 4, 8
MIN_LISTS, GROUP, TILE = 16, 16, 2048
HELD_OUT, RECALL = 200, 0.99


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def balanced_centroids(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """k-means whose distances carry a price for lists that are already long."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    size = np.full(k, len(x) / k)
    for _ in range(rounds):
        d = np.concatenate([squares(x[i : i + 4096], c) for i in range(0, len(x), 4096)])
        price = d.min(1).mean() * 0.5 * (size * k / len(x) - 1)
        at = (d + price).argmin(1)
        size = np.bincount(at, minlength=k).astype(float)
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        full = size > 0
        c[full] = total[full] / size[full, None]
        c[~full] = x[rng.choice(len(x), int((~full).sum()))]
    return c


class CentroidGraph:
    """Centroids with links to near neighbours and a few far ones, searched best first."""

    def __init__(self, c: np.ndarray, seed: int = 5):
        self.c, n = c, len(c)
        rng = np.random.default_rng(seed)
        near = []
        for i in range(0, n, 1024):
            d = squares(c[i : i + 1024], c)
            d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
            near.append(np.argsort(d, 1, kind="stable")[:, : max(1, min(DEGREE, n - 1))])
        far = rng.integers(0, n, (n, FAR_LINKS))
        self.links = np.hstack([np.concatenate(near), far]).astype(np.int32)
        self.entries = np.unique(np.linspace(0, n - 1, ENTRIES).astype(np.int32))

    def search(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row of x the ``width`` nearest centroids found, nearest first, and their distances."""
        n, width = len(self.c), min(width, len(self.c))
        rows = np.arange(len(x))[:, None]
        seen = np.zeros((len(x), n), bool)
        ids = np.full((len(x), width), -1, np.int32)
        dist = np.full((len(x), width), np.inf)
        open_ = np.zeros((len(x), width), bool)
        new = np.broadcast_to(self.entries, (len(x), len(self.entries)))
        active = np.arange(len(x))
        while len(active):
            sub = rows[: len(active)]
            fresh = ~seen[active[:, None], new]
            same = np.sort(new, 1)
            order = np.argsort(new, 1, kind="stable")
            twice = np.zeros_like(fresh)
            np.put_along_axis(twice, order[:, 1:], same[:, 1:] == same[:, :-1], 1)
            fresh &= ~twice
            seen[active[:, None], new] = True
            gap = self.c[new] - x[active][:, None, :]
            d = np.where(fresh, np.sqrt(np.einsum("ijk,ijk->ij", gap, gap)), np.inf)
            all_d = np.hstack([dist[active], d])
            all_i = np.hstack([ids[active], new.astype(np.int32)])
            all_o = np.hstack([open_[active], fresh])
            best = np.argsort(all_d, 1, kind="stable")[:, :width]
            dist[active], ids[active], open_[active] = all_d[sub, best], all_i[sub, best], all_o[sub, best]
            open_[active] &= np.isfinite(dist[active])
            active = active[open_[active].any(1)]
            if len(active):
                at = open_[active].argmax(1)
                open_[active, at] = False
                new = self.links[ids[active, at]]
        return np.where(np.isfinite(dist), ids, -1), dist

    def lists_of(self, x: np.ndarray, spread: float) -> list[np.ndarray]:
        """The lists that each vector is put on."""
        ids, dist = self.search(x, 4 * REPLICAS)
        out = []
        for own, d in zip(ids, dist):
            taken = [own[0]]
            for c, r in zip(own[1:], d[1:]):
                if len(taken) == REPLICAS or c < 0 or r > (1 + spread) * d[0]:
                    break
                if (((self.c[taken] - self.c[c]) ** 2).sum(1) >= r * r).all():
                    taken.append(c)
            out.append(np.array(taken, np.int32))
        return out

    def groups(self) -> np.ndarray:
        """The group of each list: centroids halved across their widest direction down to ``GROUP``."""
        out, parts, n = np.zeros(len(self.c), np.int32), [np.arange(len(self.c))], 0
        while parts:
            own = parts.pop()
            if len(own) <= GROUP:
                out[own], n = n, n + 1
                continue
            x = self.c[own] - self.c[own].mean(0)
            order = own[np.argsort(x @ np.linalg.eigh(x.T @ x)[1][:, -1], kind="stable")]
            parts += [order[: len(own) // 2], order[len(own) // 2 :]]
        return out

    def groups_for(self, x: np.ndarray, reach: float, of: np.ndarray, sizes: np.ndarray, enough: int) -> list[np.ndarray]:
        """The groups that each query reads: those of its lists, and further ones until they hold enough rows."""
        out = []
        for i in range(0, len(x), 256):
            dist = np.sqrt(squares(x[i : i + 256], self.c))
            for d, order in zip(dist, np.argsort(dist, 1, kind="stable")):
                n = max(MIN_LISTS, int((d <= (1 + reach) * d[order[0]]).sum()))
                own = np.unique(of[order[:n]])
                if sizes[own].sum() < enough:
                    met, first = np.unique(of[order], return_index=True)
                    met = met[np.argsort(first)]
                    own = met[: max(len(own), int(np.searchsorted(np.cumsum(sizes[met]), enough)) + 1)]
                out.append(own.astype(np.int32))
        return out


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, v`` of the rows that take part."""
    v = F.col("v")
    rows = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>").alias("v")).where(
        F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0)
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    )
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("v") == (usual[0].n if usual else 0))


def exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Distances of paired rows in double precision, summed in the order of the components."""
    gap = q.astype(np.float64) - v.astype(np.float64)
    total = np.zeros(len(gap))
    for i in range(gap.shape[1]):
        total += gap[:, i] * gap[:, i]
    return np.sqrt(total)


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(x, np.float32) for x in column]) if len(column) else np.zeros((0, 1), np.float32)


def reach_needed(vectors: DataFrame, graph: CentroidGraph, k: int, spread: float) -> float:
    """The reach at which held-out vectors find ``RECALL`` of their k nearest others among all ``vectors``."""
    held = _matrix([r.v for r in vectors.select("v").orderBy(F.xxhash64("v").desc(), "v").limit(HELD_OUT).collect()])
    shared = vectors.sparkSession.sparkContext.broadcast(held)

    def nearest(batches):
        q = shared.value.astype(np.float64)
        rows, best, found = np.arange(len(q))[:, None], np.zeros((len(q), 0)), np.zeros((len(q), 0, q.shape[1]), np.float32)
        for b in batches:
            v = _matrix(b.column("v").to_pylist())
            if not len(v):
                continue
            d = squares(q, v.astype(np.float64))
            at = np.argsort(d, 1, kind="stable")[:, : k + 1]
            best, found = np.hstack([best, d[rows, at]]), np.concatenate([found, v[at]], 1)
            at = np.argsort(best, 1, kind="stable")[:, : k + 1]  # one more, as a vector finds itself
            best, found = best[rows, at], found[rows, at]
        n = best.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(q), dtype=np.int32), n)), pa.array(best.ravel()), pa.array(list(found.reshape(-1, q.shape[1])), pa.list_(pa.float32()))], ["q", "d", "v"])

    first = Window.partitionBy("q").orderBy("d", "v")
    near = vectors.select("v").mapInArrow(nearest, "q int, d double, v array<float>").withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1).collect()
    at, v = np.array([r.q for r in near], np.int32), _matrix([r.v for r in near])
    other = (v != held[at]).any(1) if len(near) else np.zeros(0, bool)
    if not other.any():
        return 0.0
    dist = np.sqrt(squares(held.astype(np.float64), graph.c))
    rank = np.argsort(np.argsort(dist, 1, kind="stable"), 1)
    least, need = dist.min(1), []
    for q, lists in zip(at[other], graph.lists_of(v[other].astype(np.float64), spread)):
        best = lists[rank[q, lists].argmin()]
        need.append(0.0 if rank[q, best] < MIN_LISTS else dist[q, best] / max(least[q], 1e-30) - 1)
    return float(np.quantile(need, RECALL, method="higher")) + 1e-9


def search(rows: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", spread: float = 0.15, reach: float = 0.5) -> DataFrame:
    """``query_id, rank, id_col, score``: the k nearest found for each row where ``is_query`` holds."""
    spark = rows.sparkSession
    ship(spark)
    scratch = Scratch(spark, "ann")
    kind = rows.schema[id_col].dataType.simpleString()
    good = usable(rows, id_col, vector_col).distinct()
    least = Window.partitionBy("v").orderBy("id")
    vectors = scratch.cut(
        good.withColumn("n", F.row_number().over(least)).where(F.col("n") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "vectors"
    )
    n = vectors.count()
    sample = vectors.select("v").orderBy(F.xxhash64("v"), "v").limit(SAMPLE).collect()
    x = _matrix([r.v for r in sample]).astype(np.float64)
    graph = CentroidGraph(balanced_centroids(x, min(MAX_CENTROIDS, -(-n // LIST_ROWS), max(1, len(x) // 4)))) if len(x) else None
    index = spark.sparkContext.broadcast(graph)
    reach = max(reach, reach_needed(vectors, graph, k, spread)) if graph else reach
    of = graph.groups() if graph else np.zeros(0, np.int32)
    groups = spark.sparkContext.broadcast(of)

    def place(batches):
        for b in batches:
            v = _matrix(b.column("v").to_pylist())
            lists = [np.unique(groups.value[x]) for x in index.value.lists_of(v.astype(np.float64), spread)] if len(v) else []
            at = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lists) if len(v) else np.zeros(0, np.int32)), b.column("v").take(pa.array(at)), b.column("ids").take(pa.array(at))], ["part", "v", "ids"])

    postings = scratch.cut(vectors.mapInArrow(place, f"part int, v array<float>, ids array<{kind}>"), "postings")
    counts = {r.part: r.n for r in postings.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row a group
    sizes = spark.sparkContext.broadcast(np.array([counts.get(i, 0) for i in range(of.max() + 1 if graph else 0)], np.int64))

    def choose(batches):
        for b in batches:
            v = _matrix(b.column("v").to_pylist())
            lists = index.value.groups_for(v.astype(np.float64), reach, groups.value, sizes.value, REPLICAS * (k + 1)) if len(v) else []
            at = pa.array(np.repeat(np.arange(len(lists)), [len(x) for x in lists]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lists).astype(np.int32) if len(v) else np.zeros(0, np.int32)), b.column("id").take(at), b.column("v").take(at)], ["part", "id", "v"])

    asked = good.where(is_query).mapInArrow(choose, f"part int, id {kind}, v array<float>")
    asked = scratch.cut(asked, "asked")
    parts = asked.groupBy("part").agg(F.count("*").alias("q")).join(postings.groupBy("part").agg(F.count("*").alias("p")), "part")
    parts = F.broadcast(parts.select("part", F.ceil(F.col("q") / TILE).cast("int").alias("qs"), F.ceil(F.col("p") / TILE).cast("int").alias("ps")))  # a row a group
    left = asked.join(parts, "part").select("part", F.pmod(F.xxhash64("id"), "qs").cast("int").alias("qt"), F.explode(F.sequence(F.lit(0), F.col("ps") - 1)).alias("pt"), "id", "v")
    right = postings.join(parts, "part").select("part", F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("qt"), F.pmod(F.xxhash64("v"), "ps").cast("int").alias("pt"), "v", "ids")

    def tile(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(p):
            a, b, ids = _matrix(q["v"]), _matrix(p["v"]), p["ids"].tolist()
            for i in range(0, len(a), 256):
                d = squares(a[i : i + 256].astype(np.float64), b.astype(np.float64))
                kth = np.partition(d, min(k, d.shape[1] - 1), 1)[:, min(k, d.shape[1] - 1)]
                qi, pi = np.nonzero(d <= kth[:, None] * (1 + 1e-9) + 1e-9)
                score = exact(a[i + qi], b[pi])
                for own, r, s in zip(q["id"].to_numpy()[i + qi].tolist(), pi.tolist(), score.tolist()):
                    out += [(own, x, s) for x in ids[r] if x != own]
        got = pd.DataFrame(out, columns=["query_id", "id", "score"])
        return got.sort_values(["query_id", "score", "id"], kind="stable").groupby("query_id", sort=False).head(k)

    key = ["part", "qt", "pt"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(tile, f"query_id {kind}, id {kind}, score double")
    first = Window.partitionBy("query_id").orderBy("score", "id")
    return (
        found.dropDuplicates(["query_id", "id"]).withColumn("rank", F.row_number().over(first).cast("int")).where(F.col("rank") <= k)
        .select("query_id", "rank", F.col("id").alias(id_col), "score")
    )
