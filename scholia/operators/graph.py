"""Graph analytics on edge tables ``a, b``: components, communities, paths, centralities.

Iterative algorithms keep their state as tables and cut lineage by Parquet below
``spark.checkpoint.dir``. Nothing collects edges or labels; small reports are top-k.
"""

from __future__ import annotations

import atexit
import itertools
import shutil
import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Links in both directions up to which the adjacency is sent to every executor (4 bytes a link and 16 a node).
MAX_LINKS = 8_000_000


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = tempfile.mkdtemp(prefix="scholia-graph-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/scholia-graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of each edge, once, without loops."""
    e = edges.select("a", "b").where("a <> b")
    return e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """GRF8: degree and degree centrality d / (n - 1) of nodes that have edges."""
    d = symmetric(edges).groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree"))
    n = d.agg(F.count("*").alias("n"))
    return d.crossJoin(F.broadcast(n)).select("node", "degree", (F.col("degree") / F.greatest(F.col("n") - 1, F.lit(1))).alias("centrality"))


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """GRF2: ``node, component`` (smallest node reachable), by least labels with jumps to labels' labels."""
    both = cut(symmetric(edges))
    label = cut(both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("component")))
    for _ in range(max_rounds):
        near = both.join(label.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("low"))
        step = label.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "low").alias("component"))
        jump = label.select(F.col("node").alias("component"), F.col("component").alias("far"))
        new = cut(step.join(jump, "component", "left").select("node", "was", F.least("component", "far").alias("component")))
        label = new.select("node", "component")
        if new.where("was <> component").limit(1).isEmpty():
            return label
    raise RuntimeError("components did not settle")


def page_rank(edges: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float | None = 1e-6) -> DataFrame:
    """GRF11: ``node, rank``, synchronous, undirected; stops when no rank changes by ``tolerance`` (None: all rounds)."""
    both = symmetric(edges)
    deg = both.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree"))
    links = cut(both.join(deg, both["a"] == deg["node"]).select("a", "b", "degree"))
    nodes = cut(deg.select("node"))
    n = nodes.count()
    rank = nodes.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for i in range(rounds):
        sent = links.join(rank, links["a"] == rank["node"]).groupBy(F.col("b").alias("node")).agg(F.sum(F.col("rank") / F.col("degree")).alias("got"))
        new = nodes.join(sent, "node", "left").select("node", (F.lit((1 - damping) / max(n, 1)) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        if tolerance is not None or i % 4 == 3:
            new = cut(new)
        if tolerance is not None:
            gap = new.join(rank.withColumnRenamed("rank", "was"), "node").agg(F.max(F.abs(F.col("rank") - F.col("was"))).alias("d")).collect()[0].d
            if gap is not None and gap < tolerance:
                return new
        rank = new
    return rank


def distances(edges: DataFrame, sources: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """GRF5/GRF10: ``source, node, distance, parent`` by level-wise search from all sources at once,
    until nothing new is reached; with ``max_rounds`` only nodes up to that distance.

    The parent is the smallest node of the level before, so paths are the same in every run.
    """
    both = cut(symmetric(edges))
    found = cut(sources.select(F.col("node").alias("source"), "node", F.lit(0).alias("distance"), F.lit(None).cast("long").alias("parent")))
    front = found
    for level in itertools.count(1) if max_rounds is None else range(1, max_rounds + 1):
        step = front.join(both, front["node"] == both["a"]).groupBy("source", F.col("b").alias("node")).agg(F.min("a").alias("parent"))
        fresh = cut(step.join(found.select("source", "node"), ["source", "node"], "left_anti").select("source", "node", F.lit(level).alias("distance"), "parent"))
        if fresh.limit(1).isEmpty():
            return found
        found, front = cut(found.unionByName(fresh)), fresh
    return found


def closeness(dist: DataFrame) -> DataFrame:
    """GRF10: one over the mean distance to the nodes reached; 0 where none is."""
    return dist.groupBy(F.col("source").alias("node")).agg(F.coalesce(F.count_if(F.col("distance") > 0) / F.nullif(F.sum("distance"), F.lit(0)), F.lit(0.0)).alias("closeness"))


def adjacency(both: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``ids, start, col`` of symmetric links: the nodes in order, and the places of the neighbours of node ``i`` in ``col[start[i] : start[i + 1]]``."""
    t = both.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).toArrow()
    a, b = t.column("a").to_numpy(), t.column("b").to_numpy()
    ids = np.unique(a)
    code = np.sort(np.searchsorted(ids, a) * len(ids) + np.searchsorted(ids, b))
    start = np.searchsorted(code, np.arange(len(ids) + 1) * len(ids))
    return ids, start, (code % max(len(ids), 1)).astype(np.int32)


def _spread(start: np.ndarray, col: np.ndarray, sources: np.ndarray, every: bool) -> tuple[np.ndarray, np.ndarray]:
    """Nodes reached and the sum of their distances, for searches from all ``sources`` (places) at once, a bit each.

    For each source; with ``every`` for each node, counting the sources it reaches, as distances are the same both ways.
    """
    n, width = len(start) - 1, -(-len(sources) // 64)
    front = np.zeros((n, width), np.uint64)
    place = np.arange(len(sources))
    np.bitwise_or.at(front, (sources, place // 64), np.uint64(1) << (place % 64).astype(np.uint64))
    seen, size = front.copy(), n if every else len(sources)
    reached, total = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for level in itertools.count(1):
        front = np.bitwise_or.reduceat(front[col], start[:-1], axis=0)
        front &= ~seen
        if every:
            new = np.bitwise_count(front).sum(1, dtype=np.int64)
        else:
            new = np.zeros(width * 64, np.int64)
            for at in range(0, n, 4096):
                new += np.unpackbits(front[at : at + 4096].astype("<u8").view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            new = new[:size]
        if not new.any():
            return reached, total
        seen |= front
        reached += new
        total += level * new


def closeness_from(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """GRF10: ``node, closeness`` of ``sources(node)`` (distinct; None: all nodes with edges), the whole graph searched from each.

    Many searches run at once, a bit each, over the adjacency, which is broadcast; no table of pairs is made. Above
    ``MAX_LINKS`` links it is ``distances``, whose table has a row for each source and node.
    """
    both = cut(symmetric(edges))
    every = sources is None
    nodes = both.select(F.col("a").alias("node")).distinct()
    sources = nodes if every else sources.select("node")
    if both.count() > MAX_LINKS:
        return closeness(distances(edges, sources))
    shared = edges.sparkSession.sparkContext.broadcast(adjacency(both))
    width = max(64, min(1024, 64 * (4_000_000 // max(len(shared.value[2]), 1))))  # about 32 MB of bits at the links

    def run(batches):
        ids, start, col = shared.value
        reached, total = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        for b in batches:
            own = b.column("node").to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(ids, own), max(len(ids) - 1, 0))
            known = ids[at] == own if len(ids) else np.zeros(len(own), bool)
            places, k, d = at[known], np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
            for i in range(0, len(places), width):
                r, t = _spread(start, col, places[i : i + width], every)
                if every:
                    reached += r
                    total += t
                else:
                    k[np.flatnonzero(known)[i : i + width]], d[np.flatnonzero(known)[i : i + width]] = r, t
            if not every:
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(k), pa.array(d)], ["node", "k", "d"])
        if every:
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(reached), pa.array(total)], ["node", "k", "d"])

    tasks = 4 * edges.sparkSession.sparkContext.defaultParallelism
    sums = sources.select(F.col("node").cast("long").alias("node")).repartition(tasks, "node").mapInArrow(run, "node long, k long, d long")
    if every:
        sums = sums.groupBy("node").agg(F.sum("k").alias("k"), F.sum("d").alias("d"))
    return sums.select("node", F.coalesce(F.col("k") / F.nullif(F.col("d"), F.lit(0)), F.lit(0.0)).alias("closeness"))


def shortest_path(dist: DataFrame, source: int, target: int) -> list[int]:
    """GRF5: the nodes from source to target, walking parents; empty if there is no path. At most one lookup a step."""
    own = dist.where(F.col("source") == source)
    path, at = [target], target
    while at != source:
        row = own.where(F.col("node") == at).limit(1).collect()
        if not row:
            return []
        at = row[0].parent
        path.append(at)
    return path[::-1]


def simple_paths(edges: DataFrame, source: int, target: int, max_length: int = 5) -> DataFrame:
    """GRF6: ``path`` of all paths without repeats of up to ``max_length`` edges. Paths are pruned by their distance to the target."""
    both = cut(symmetric(edges))
    spark = edges.sparkSession
    back = distances(edges, spark.createDataFrame([(target,)], "node long"), max_length).select(F.col("node").alias("b"), F.col("distance").alias("togo"))
    paths = spark.createDataFrame([([source], source)], "path array<long>, at long")
    out = None
    for i in range(1, max_length + 1):
        nxt = paths.join(both, paths["at"] == both["a"]).where(~F.array_contains("path", F.col("b"))).join(back, "b").where(F.col("togo") <= max_length - i)
        nxt = cut(nxt.select(F.concat("path", F.array("b")).alias("path"), F.col("b").alias("at")))
        done = nxt.where(F.col("at") == target).select("path")
        out = done if out is None else out.unionByName(done)
        paths = nxt.where(F.col("at") != target)
    return out


def label_communities(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """A parallel variant of ours for large graphs (not the sequential Louvain): synchronous label propagation,
    ties to the smaller label, every other round kept to damp swings."""
    both = cut(symmetric(edges))
    label = cut(both.select(F.col("a").alias("node")).distinct().withColumn("community", F.col("node")))
    for i in range(rounds):
        votes = both.join(label.select(F.col("node").alias("b"), "community"), "b").groupBy(F.col("a").alias("node"), "community").agg(F.count("*").alias("n"))
        best = votes.groupBy("node").agg(F.max_by("community", F.struct("n", -F.col("community"))).alias("to"))
        label = cut(label.join(best, "node").select("node", F.when((F.xxhash64("node", F.lit(i)) % 4) != 0, F.col("to")).otherwise(F.col("community")).alias("community")))
    return label


def louvain(edges: DataFrame, passes: int = 10, max_edges: int = 5_000_000) -> DataFrame:
    """GRF3: ``node, community`` of the simplified sequential Louvain: nodes in order, up to ``passes`` passes; a
    node moves to the neighbouring community with most links to it if these exceed those to its own by more
    than those to its own again (gain = to - own, which has to beat own). Communities are named by their
    smallest node.

    The order of moves defines the result, so this runs in one task; the edge count is checked, and
    larger graphs are for ``label_communities``.
    """
    both = symmetric(edges)
    n = both.count()
    if n > 2 * max_edges:
        raise ValueError(f"{n // 2} edges; the sequential method takes at most {max_edges}")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, list[int]] = {}
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist()):
            near.setdefault(a, []).append(b)
        of = {x: x for x in near}
        for _ in range(passes):
            moved = False
            for x in sorted(near):
                own, count = of[x], {}
                for y in near[x]:
                    count[of[y]] = count.get(of[y], 0) + 1
                stay = count.get(own, 0)
                best, gain = own, stay
                for c in sorted(count):
                    if c != own and count[c] - stay > gain:
                        best, gain = c, count[c] - stay
                if best != own:
                    of[x], moved = best, True
            if not moved:
                break
        least: dict[int, int] = {}
        for x, c in of.items():
            least[c] = min(x, least.get(c, x))
        return pd.DataFrame({"node": list(of), "community": [least[c] for c in of.values()]})

    return both.withColumn("g", F.lit(1)).groupBy("g").applyInPandas(run, "node long, community long")


def describe_communities(edges: DataFrame, communities: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """GRF4: size, density 2 * internal / (n (n - 1)), hub (largest degree, then smallest node) and first members of communities of two or more."""
    both = symmetric(edges)
    inner = both.join(communities.withColumnRenamed("node", "a"), "a").join(communities.select(F.col("node").alias("b"), F.col("community").alias("c2")), "b").where("community = c2")
    internal = inner.groupBy("community").agg((F.count("*") / 2).alias("internal"))
    deg = both.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree"))
    w = Window.partitionBy("community").orderBy("node")
    members = communities.join(deg, "node").withColumn("nth", F.row_number().over(w))
    by = members.groupBy("community").agg(F.count("*").alias("size"), F.max_by("node", F.struct("degree", -F.col("node"))).alias("hub"), F.sort_array(F.collect_list(F.when(F.col("nth") <= 5, F.col("node")))).alias("first_members")).where("size > 1")
    return by.join(internal, "community", "left").select("community", "size", "hub", "first_members", (2 * F.coalesce("internal", F.lit(0.0)) / (F.col("size") * (F.col("size") - 1))).alias("density"))


def _dependencies(start: np.ndarray, col: np.ndarray, sources: np.ndarray) -> np.ndarray:
    """The sum of the sources' (places) dependencies on each node, by Brandes' method, level by level for all sources at once."""
    n, k = len(start) - 1, len(sources)
    level, paths = np.full(k * n, -1, np.int32), np.zeros(k * n)
    mark = np.zeros(k * n, np.int64)
    front = np.arange(k) * n + sources
    level[front], paths[front] = 0, 1.0
    steps, near = [], start[1:] - start[:-1]
    for d in itertools.count(1):
        node = front % n
        links = near[node]
        ends = np.cumsum(links)
        other = col[np.arange(ends[-1]) + np.repeat(start[node] - ends + links, links)] + np.repeat(front - node, links)
        old = level[other]
        open_ = old < 0
        other, counts = other[open_], np.add.reduceat(open_, ends - links, dtype=np.int64)
        if not len(other):
            break
        level[other] = d
        own = np.repeat(front, counts)
        np.add.at(paths, other, paths[own])
        steps.append((own, other))
        mark[other] = np.arange(len(other))
        front = other[mark[other] == np.arange(len(other))]
    share = np.zeros(k * n)
    for own, other in reversed(steps):
        np.add.at(share, own, paths[own] / paths[other] * (1 + share[other]))
    share[np.arange(k) * n + sources] = 0
    return share.reshape(k, n).sum(0)


def betweenness(edges: DataFrame, sources: DataFrame | None = None, max_links: int = MAX_LINKS) -> DataFrame:
    """GRF9: betweenness by Brandes' method, from sources dealt to tasks, some at once.

    Exact with all nodes as sources; with a seeded sample of them the sum is scaled up. The adjacency
    is broadcast, so its size is checked (``max_links`` in both directions). Exact costs nodes times links.
    """
    spark = edges.sparkSession
    both = cut(symmetric(edges))
    if both.count() > max_links:
        raise ValueError("the graph is too large to be broadcast; sample it first")
    nodes = both.select(F.col("a").alias("node")).distinct()
    shared = spark.sparkContext.broadcast(adjacency(both))
    n = len(shared.value[0])
    sources = nodes if sources is None else sources
    m = n if sources is nodes else sources.count()
    many = max(1, min(256, 100_000 // max(n, 1)))  # so that the states stay in the processor's cache

    def run(batches):
        ids, start, col = shared.value
        total = np.zeros(len(ids))
        for b in batches:
            own = np.sort(b.column("node").to_numpy(zero_copy_only=False))
            at = np.minimum(np.searchsorted(ids, own), max(len(ids) - 1, 0))
            at = at[ids[at] == own] if len(ids) else at[:0]
            for i in range(0, len(at), many):
                total += _dependencies(start, col, at[i : i + many])
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], ["node", "part"])

    tasks = 4 * spark.sparkContext.defaultParallelism
    parts = sources.select(F.col("node").cast("long").alias("node")).repartition(tasks, "node").mapInArrow(run, "node long, part double")
    scale = (n / max(m, 1)) / max((n - 1) * (n - 2), 1)
    return nodes.join(parts.groupBy("node").agg(F.sum("part").alias("part")), "node", "left").select("node", (F.coalesce("part", F.lit(0.0)) * scale).alias("betweenness"))


def statistics(edges: DataFrame) -> DataFrame:
    """AGG13: nodes, edges, mean, largest and smallest degree, density E / (n (n - 1) / 2)."""
    d = symmetric(edges).groupBy("a").agg(F.count("*").alias("degree"))
    s = d.agg(F.count("*").alias("nodes"), F.sum("degree").alias("ends"), F.avg("degree").alias("mean"), F.max("degree").alias("max_degree"), F.min("degree").alias("min_degree"))
    n = F.col("nodes")
    return s.select("nodes", (F.col("ends") / 2).cast("long").alias("edges"), F.round("mean", 2).alias("mean_degree"), "max_degree", "min_degree", F.round(F.col("ends") / (n * (n - 1)), 4).alias("density"))
