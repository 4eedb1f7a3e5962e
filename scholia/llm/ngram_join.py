"""Operator 7: an exact Jaccard self-join on word shingles by size-banded tiles and hashed bitmaps.

1. Each text becomes the sorted set of its shingles' 64-bit hashes. Equal sets are one node, named
   by a hash of the set, so copies cost one row.
2. Stars: nodes that share one of their least hashes and a size band are compared with the bucket's
   centre, drawn by hash; first by the least hash alone, then by the others where components still
   differ. These real links make first components.
3. Completion: sets at or above the threshold share a shingle among the first
   ``n - ceil(t * n) + 1`` of any common order. The order puts shingles that only one node holds
   first, as told by a Bloom filter of fixed size, then the others by how often they are held, then by hash.
   So a prefix holds shared shingles only where a set consists of them for the most part, and only
   those make rows. Holders of a shingle that are all in one component are finished; the others
   meet in tiles of a shingle and a size band (two sets that link lie in the same or adjacent bands
   of ratio 1 / t). In a tile only pairs of different components and fitting sizes count, and bit
   counts of hashed bitmaps bound their overlap from above. First rounds take each component's
   pair of largest bound only, which connects large groups of near copies by few comparisons; once
   a round finds no link (or after ``ROUNDS``), all pairs left are taken.
4. Pairs left, those of stars as well, pass the bound of their bitmaps and are then decided by
   intersecting the sorted arrays; all links are joined to components.

No link is lost: steps only skip pairs that are already connected or provably too far apart, and
nothing is capped. Tiles above ``TILE`` rows or ``TILE_BYTES`` of bitmaps are cut into blocks that
meet pairwise.

Scale: texts are never shuffled while the keys of the rows to be read again can be broadcast (a
checked bound); otherwise they are joined once. What is moved are four bytes a shingle for the
filter, and rows for the shared shingles of prefixes. Where the input saturates the filter, more
shingles count as shared, with the same result; raise ``bloom_bytes`` with the executors.

Edge cases: null and empty texts and texts without words have empty sets and are linked with
nothing; with fewer words than a shingle the whole sequence is the one shingle; rows with a null id
are linked with nothing and have a null component; rows that share an id are told apart by their
texts, equal rows are copies; texts of any length are read whole; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm import twice
from scholia.llm.common import WS_BYTES, Scratch, components, free_shuffles, release, restrict, ship

STARS, ROUNDS, TILE, TILE_BYTES, TOP, MAX_HOT, CHUNK, PAIRS = 6, 8, 2048, 8 << 20, 50_000, 200_000, 1_000_000, 200_000
BLOOM_BYTES, SEGMENT, SLICE, BATCH = 16 << 20, 1 << 20, 100_000, 2 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)
SPACE = np.isin(np.arange(256), np.frombuffer(WS_BYTES, np.uint8))


def scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Shingler:
    """Sets of shingle hashes of many texts at once.

    A word's hash is a polynomial of its bytes, taken from running sums over the whole batch.
    """

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, words: int, seed: int):
        self.k, self.seed = words, seed
        self.letters = np.random.default_rng(seed).integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.up, self.down = powers(self.BASE, SEGMENT), powers(pow(self.BASE, -1, 1 << 64), SEGMENT + 1)

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.letters[data] * self.up[: len(data)], out=out[1:])
        return out

    def codes(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the words ``data[start:end]``, in pieces of at most SEGMENT bytes."""
        out = np.zeros(len(start), np.uint64)
        piece = start // SEGMENT
        cut = end > (piece + 1) * SEGMENT
        for at in range(0, len(data), SEGMENT):
            a, b = np.searchsorted(start, [at, at + SEGMENT])
            own = np.arange(a, b)[~cut[a:b]]
            if len(own):
                total = self.sums(data[at : at + SEGMENT])
                out[own] = (total[end[own] - at] - total[start[own] - at]) * self.down[start[own] - at]
        for i in np.flatnonzero(cut):  # words across two pieces, each by itself
            word = data[start[i] : end[i]]
            out[i] = self.sums(word)[-1] if len(word) <= SEGMENT else xxhash.xxh3_64_intdigest(word.tobytes(), self.seed)
        return scramble(out + (end - start).astype(np.uint64) * MIX)

    def sets(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """For each text the sorted distinct hashes of its shingles."""
        raw = b"\n".join([(t or b"") for t in texts]).lower() + b"\n"
        data = np.frombuffer(raw, np.uint8)
        edge = np.flatnonzero(np.diff(np.concatenate([[True], SPACE[data]]).view(np.int8)))
        start, end = edge[::2], edge[1::2]
        code = self.codes(data, start, end)
        stops = np.cumsum([len(t or b"") + 1 for t in texts])
        last = np.searchsorted(start, stops)
        factors = [np.uint64(pow(self.BASE, 2 * i + 3, 1 << 64)) for i in range(self.k)]
        h = np.zeros(0, np.uint64)
        if len(code) >= self.k:
            m = len(code) - self.k + 1
            h = code[:m] * factors[0]
            for i in range(1, self.k):
                h += code[i : m + i] * factors[i]
            h = scramble(h)
        out, at = [], 0
        for n in np.diff(last, prepend=0).tolist():
            if n >= self.k:
                own = np.sort(h[at : at + n - self.k + 1])
                new = own[1:] != own[:-1]
                out.append(own if new.all() else own[np.append(True, new)])
            elif n:
                own = code[at : at + n] * np.array(factors[:n])
                out.append(scramble(own.sum(keepdims=True) + np.uint64(n)))
            else:
                out.append(np.zeros(0, np.uint64))
            at += n
        return out


def node_of(own: np.ndarray) -> tuple[int, int]:
    """A name of a set, and a second hash that tells names apart."""
    d = xxhash.xxh3_128_digest(own.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def band_of(n: np.ndarray, t: float) -> np.ndarray:
    return np.floor(np.log(np.maximum(n, 1)) / -math.log(t) + 1e-9).astype(np.int32)


def width_of(n: int) -> int:
    """Bits of a set's bitmap: about four for a shingle, at least 512."""
    return 1 << max(9, min(17, int(4 * n - 1).bit_length()))


def bitmap(own: np.ndarray) -> bytes:
    width = width_of(len(own))
    bits = np.zeros(width, np.uint8)
    bits[(own >> np.uint64(20)).astype(np.int64) & (width - 1)] = 1
    return np.packbits(bits).tobytes()


def folded(maps: list[bytes]) -> np.ndarray:
    """Bitmaps as rows of equal width: wider ones are folded, which keeps the bounds valid."""
    least = min(map(len, maps))
    out = np.empty((len(maps), least), np.uint8)
    for i, m in enumerate(maps):
        a = np.frombuffer(m, np.uint8)
        out[i] = a if len(a) == least else np.bitwise_or.reduce(a.reshape(-1, least), 0)
    return out.view(np.uint64)


def most_common(na: int, nb: int, p: bytes, q: bytes) -> int:
    """An upper bound of the overlap of two sets of these sizes with these bitmaps."""
    a, b = folded([p, q])
    both = int(np.bitwise_count(a & b).sum())
    return min(na - int(np.bitwise_count(a).sum()), nb - int(np.bitwise_count(b).sum())) + both


def needed(na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap at which two sets of these sizes link."""
    return -(-percent * (na + nb) // (100 + percent))


def tile_pairs(node: np.ndarray, comp: np.ndarray, n: np.ndarray, maps: list[bytes], home: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a tile that may link (places in it, and by how much the bound exceeds what is needed): one
    of them at home in the band, of different components, sizes and bits fitting."""
    bits, out_i, out_j, out_m = folded(maps), [], [], []
    for i in range(len(node) - 1):
        j = np.arange(i + 1, len(node))
        j = j[(home[i] | home[j]) & (comp[j] != comp[i]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))]
        if len(j):
            both = np.bitwise_count(bits[i] & bits[j]).sum(1).astype(np.int64)
            own, other = int(np.bitwise_count(bits[i]).sum()), np.bitwise_count(bits[j]).sum(1).astype(np.int64)
            most = np.minimum(n[i] - (own - both), n[j] - (other - both))
            over = most - needed(n[i], n[j], percent)
            j, over = j[over >= 0], over[over >= 0]
            out_i.append(np.full(len(j), i))
            out_j.append(j)
            out_m.append(over / (n[i] + n[j]))
    z = np.zeros(0, np.int64)
    return (np.concatenate(out_i), np.concatenate(out_j), np.concatenate(out_m)) if out_i else (z, z, z)


def texts_of(b: pa.RecordBatch) -> list[bytes | None]:
    return b.column("text").cast(pa.binary()).to_pylist()


def profile(docs: DataFrame, words: int, seed: int) -> DataFrame:
    """``id, k, node, node2, n, least``: for each row the names of its set, the set's size and least hashes."""

    def run(batches):
        shingler = Shingler(words, seed)
        for b in batches:
            sets = shingler.sets(texts_of(b))
            names = np.array([node_of(s) for s in sets], np.int64).reshape(-1, 2)
            least = [s[:STARS].view(np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("k"), pa.array(names[:, 0].copy()), pa.array(names[:, 1].copy()), pa.array([len(s) for s in sets], pa.int64()), pa.array(least, pa.list_(pa.int64()))],
                ["id", "k", "node", "node2", "n", "least"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, k long, node long, node2 long, n long, least array<long>")


def sets_of(docs: DataFrame, words: int, seed: int, arrays: bool = True) -> DataFrame:
    """``node, bits`` and with ``arrays`` ``items`` of each text that has words."""

    def run(batches):
        shingler = Shingler(words, seed)
        for b in batches:
            sets = [s for s in shingler.sets(texts_of(b)) if len(s)]
            columns = [pa.array([node_of(s)[0] for s in sets], pa.int64()), pa.array([bitmap(s) for s in sets], pa.binary())]
            if arrays:
                columns.append(pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, ["node", "bits", "items"][: len(columns)])

    return docs.mapInArrow(run, "node long, bits binary" + ", items array<long>" * arrays).dropDuplicates(["node"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose sets reach the threshold: bitmaps bound the overlap first."""

    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            x, y = batch.column("x"), batch.column("y")
            xo, yo, xv, yv = x.offsets.to_numpy(), y.offsets.to_numpy(), x.values.to_numpy(), y.values.to_numpy()
            maps = [batch.column(c).to_pylist() for c in ("p", "q")]
            for i in range(batch.num_rows):
                na, nb = int(xo[i + 1] - xo[i]), int(yo[i + 1] - yo[i])
                need = -(-percent * (na + nb) // (100 + percent))
                if most_common(na, nb, maps[0][i], maps[1][i]) < need:
                    continue
                p, q = xv[xo[i] : xo[i + 1]].view(np.uint64), yv[yo[i] : yo[i + 1]].view(np.uint64)
                small, large = (p, q) if len(p) <= len(q) else (q, p)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                keep[i] = int((large[at] == small).sum()) >= need
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    left, right = (sets.select(F.col("node").alias(n), F.col("items").alias(v), F.col("bits").alias(m)) for n, v, m in (("a", "x", "p"), ("b", "y", "q")))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y", "p", "q").mapInArrow(run, "a long, b long")


def star_pairs(nodes: DataFrame, percent: int, first: int, last: int) -> DataFrame:
    """Each node with one node, drawn by hash, of its buckets ``first`` to ``last - 1`` (place among the least hashes, hash, band).

    ``nodes``: node, n, band, least and comp; pairs within a component are left out.
    """
    flat = nodes.select("node", "n", "band", "comp", F.explode(F.slice("least", first + 1, last - first)).alias("h"))
    low = flat.groupBy("h", "band").agg(F.min(F.struct(F.xxhash64("h", "node").alias("r"), "node", "n", "comp")).alias("low"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("x != y").select("h", "band", "low")
    pairs = flat.join(low, ["h", "band"]).where(F.col("low.comp") != F.col("comp")).where(F.least("n", "low.n") * 100 >= F.greatest("n", "low.n") * percent)
    return pairs.select(F.least("low.node", "node").alias("a"), F.greatest("low.node", "node").alias("b")).distinct()


def shared_shingles(docs: DataFrame, words: int, seed: int, bloom_bytes: int) -> twice.Filter:
    """The filter of the shingles that two rows share (``docs``: no two rows of one set, but for repeated rows)."""
    total = docs.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    buckets = twice.bucket_count(int(total) // 6)

    def run(batches):
        shingler, chunk = Shingler(words, seed), twice.Chunk(buckets, CHUNK)
        for b in batches:
            for s in shingler.sets(texts_of(b)):
                if (full := chunk.add(s)) is not None:
                    yield full
        if (rest := chunk.flush()) is not None:
            yield rest
        release()

    return twice.build(docs.select("text").mapInArrow(run, twice.SCHEMA), buckets, bloom_bytes, MAX_HOT)


def postings(docs: DataFrame, words: int, seed: int, percent: int, shared) -> DataFrame:
    """``token, node`` of the shingles in the prefix of each set that other sets may hold (``shared``: a broadcast filter)."""

    def run(batches):
        shingler = Shingler(words, seed)
        for b in batches:
            sets = [s for s in shingler.sets(texts_of(b)) if len(s)]
            tokens, nodes, sizes = [], [], []
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            level = np.concatenate([shared.value.level(flat[i : i + SLICE]) for i in range(0, len(flat), SLICE)] or [np.zeros(0, np.uint8)])
            at = 0
            for s in sets:
                own = level[at : at + len(s)]
                at += len(s)
                left = len(s) + percent * len(s) // -100 + 1 - int((own == 0).sum())  # of the prefix, behind the unshared
                if left > 0:
                    late = np.flatnonzero(own)
                    late = late[np.argsort(own[late], kind="stable")][:left]
                    tokens.append(s[late])
                    nodes.append(node_of(s)[0])
                    sizes.append(left)
            flat = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), pa.array(np.repeat(np.array(nodes, np.int64), np.array(sizes, np.int64)))], ["token", "node"])
        release()

    return docs.mapInArrow(run, "token long, node long")


def tiles(scratch: Scratch, rows: DataFrame, maps: DataFrame, percent: int, partitions: int, best: bool) -> DataFrame:
    """Candidate pairs ``a, b`` of rows ``token, node, comp, n, band`` in tiles of token and band: all of
    them, or (``best``) for each component only the one whose bound is largest for its sizes.

    Bitmaps (``maps``: node, bits) join only rows of tiles that hold a possible pair, and are moved once.
    """
    both = rows.withColumn("home", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("tile", F.when(F.col("home"), F.col("band")).otherwise(F.col("band") + 1))
    counts = both.groupBy("token", "tile").agg(F.count("*").alias("c"), F.count_if("home").alias("homes"), F.min("comp").alias("x"), F.max("comp").alias("y"), F.max("n").alias("n"))
    wide = F.least(F.greatest(F.col("n"), F.lit(64)), F.lit(16384))  # bytes of the widest bitmap, at most
    blocks = F.ceil(F.greatest(F.col("c") / TILE, F.col("c") * wide / TILE_BYTES)).cast("int")
    counts = counts.where("c > 1 AND homes > 0 AND x != y").select("token", "tile", blocks.alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    placed = both.join(counts, ["token", "tile"]).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = scratch.cut(placed.select("token", "tile", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "comp", "n", "home"), "placed")
    free_shuffles(rows.sparkSession)
    key = ["token", "tile", "i", "j"]
    placed = placed.join(maps, "node").repartition(partitions, *key).sortWithinPartitions(*key, "node")

    def batch_of(a, b):
        got = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(got[:, 0].copy()), pa.array(got[:, 1].copy())], ["a", "b"])

    def pairs_of(cols, top):
        seen_a, seen_b, held = [], [], 0
        same = np.ones(len(cols["node"]), bool)
        same[1:] = False
        for k in key:
            same[1:] |= cols[k][1:] != cols[k][:-1]
        starts = np.append(np.flatnonzero(same), len(same))
        for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
            if e - s > 1:
                node, comp = cols["node"][s:e], cols["comp"][s:e]
                i, j, over = tile_pairs(node, comp, cols["n"][s:e], cols["bits"][s:e], cols["home"][s:e], percent)
                if best and len(i):
                    order = np.argsort(over, kind="stable")
                    for own in (comp[i[order]], comp[j[order]]):  # of equal components the last, largest, stays
                        last = dict(zip(own.tolist(), order.tolist()))
                        for c, at in last.items():
                            if c not in top or top[c][0] < over[at]:
                                top[c] = (float(over[at]), int(node[i[at]]), int(node[j[at]]))
                elif len(i):
                    seen_a.append(np.minimum(node[i], node[j]))
                    seen_b.append(np.maximum(node[i], node[j]))
                    held += len(i)
                    if held >= PAIRS:
                        yield batch_of(seen_a, seen_b)
                        seen_a, seen_b, held = [], [], 0
        if seen_a:
            yield batch_of(seen_a, seen_b)

    def of_components(top):
        c = list(top)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array([top[x][0] for x in c], pa.float64()), pa.array([min(top[x][1:]) for x in c], pa.int64()), pa.array([max(top[x][1:]) for x in c], pa.int64())], ["comp", "over", "a", "b"])

    def run(batches):
        rest, top = None, {}
        for b in batches:
            new = {c: (b.column(c).to_pylist() if c == "bits" else b.column(c).to_numpy(zero_copy_only=False)) for c in (*key, "node", "comp", "n", "bits", "home")}
            cols = new if rest is None else {c: rest[c] + new[c] if c == "bits" else np.concatenate([rest[c], new[c]]) for c in new}
            if not len(cols["node"]):
                continue
            end = np.ones(len(cols["node"]), bool)
            for k in key:
                end &= cols[k] == cols[k][-1]
            cut = int(np.flatnonzero(end)[0])  # sorted: the last tile may go on in the next batch
            yield from pairs_of({c: v[:cut] for c, v in cols.items()}, top)
            if len(top) > TOP:
                yield of_components(top)
                top = {}
            rest = {c: v[cut:] for c, v in cols.items()}
        if rest is not None:
            yield from pairs_of(rest, top)
        if best:
            yield of_components(top)
        release()

    if best:
        found = placed.mapInArrow(run, "comp long, over double, a long, b long")
        return found.groupBy("comp").agg(F.max(F.struct("over", "a", "b")).alias("x")).select("x.a", "x.b").distinct()
    return placed.mapInArrow(run, "a long, b long").distinct()


def linked(scratch: Scratch, docs: DataFrame, words: int, percent: int, bloom_bytes: int) -> DataFrame:
    """``id, k, n, root, component_id`` for rows ``id, k, text``, ``k`` a hash of the text: root names the component, if it has one."""
    spark = docs.sparkSession
    for seed in range(1, 6):  # two sets of one name: all names anew
        rows = scratch.cut(profile(docs, words, seed), f"profile-{seed}")
        real = rows.where("n > 0 AND id IS NOT NULL")
        names = scratch.cut(real.groupBy("node").agg(F.min("id").alias("rep"), (F.min("node2") != F.max("node2")).alias("clash"), F.count("*").alias("copies")), f"names-{seed}")
        if names.where("clash").limit(1).isEmpty():
            break
    else:
        raise RuntimeError("hashes of sets keep clashing")
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    firsts = names.where("copies > 1").select("node", "rep")
    later = scratch.cut(real.select("id", "k", "node").join(firsts, "node").where(F.col("id") != F.col("rep")).select("id", "k").distinct(), "later")
    some = not later.limit(1).isEmpty()
    docs = docs.where(F.col("id").isNotNull())
    sole = restrict(docs, ["id", "k"], later, "left_anti") if some else docs  # a row for each set, or repeated rows
    nodes = restrict(real, ["id", "k"], later, "left_anti") if some else real
    band = F.floor(F.log("n") / -math.log(percent / 100) + 1e-9).cast("int")
    nodes = scratch.cut(nodes.select("id", "k", "node", "n", band.alias("band"), "least"), "nodes")
    free_shuffles(spark)

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        pairs = scratch.cut(pairs, f"{name}-pairs")
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        keys = scratch.cut(nodes.join(ends, "node", "left_semi").select("id", "k"), f"{name}-keys")
        out = scratch.cut(confirmed(pairs, sets_of(restrict(sole, ["id", "k"], keys), words, seed), percent), f"{name}-links")
        scratch.drop(f"{name}-pairs", f"{name}-keys")
        free_shuffles(spark)
        return out

    def rooted(df: DataFrame, roots: DataFrame | None, *columns: str) -> DataFrame:
        if roots is None:
            return df.select(*columns, F.col("node").alias("comp"))
        return df.join(roots.select("node", "root"), "node", "left").select(*columns, F.coalesce("root", "node").alias("comp"))

    links = roots = None

    def join(new: DataFrame, name: str) -> bool:
        nonlocal links, roots
        if new.limit(1).isEmpty():
            return False
        links = new if links is None else links.unionByName(new)
        roots = scratch.cut(components(scratch, links, name), f"{name}-roots")
        free_shuffles(spark)
        return True

    for first, last in ((0, 1), (1, STARS)):
        if first < last:
            join(verified(star_pairs(rooted(nodes, roots, "node", "n", "band", "least"), percent, first, last), f"star-{first}"), f"first-{first}")
    shared = spark.sparkContext.broadcast(shared_shingles(sole, words, seed, bloom_bytes))
    free_shuffles(spark)
    posts = scratch.cut(postings(sole, words, seed, percent, shared), "posts")
    best = True
    for step in range(ROUNDS + 1):  # rounds of each component's best pair, then all pairs left
        with_comp = scratch.cut(rooted(posts, roots, "token", "node"), f"comp-{step}")
        open_tokens = with_comp.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x != y").select("token")
        sizes = nodes.select("node", "n", "band").distinct()
        left = scratch.cut(with_comp.join(open_tokens, "token", "left_semi").join(sizes, "node"), f"open-{step}")
        posts = left.select("token", "node")  # settled shingles stay settled
        scratch.drop(f"comp-{step}", "posts", f"open-{step - 1}")
        free_shuffles(spark)
        if left.limit(1).isEmpty():
            break
        keys = scratch.cut(nodes.join(left.select("node").distinct(), "node", "left_semi").select("id", "k"), f"keys-{step}")
        maps = sets_of(restrict(sole, ["id", "k"], keys), words, seed, arrays=False)
        best = best and step < ROUNDS
        pairs = scratch.cut(tiles(scratch, left, maps, percent, partitions, best), f"tile-{step}")
        scratch.drop("placed", f"keys-{step}")
        if pairs.limit(1).isEmpty():
            break
        more = join(verified(pairs, f"tile-{step}"), f"round-{step}")
        if not best:
            break
        best = more
    shared.destroy()
    if roots is None:
        label = names.select("node", "rep", F.lit(None).cast("long").alias("root"), F.col("rep").alias("component_id"), "copies")
    else:
        tied = scratch.cut(names.join(roots.select("node", "root"), "node"), "tied")
        least = tied.groupBy("root").agg(F.min("rep").alias("component_id"))
        label = names.join(tied.join(least, "root").select("node", "root", "component_id"), "node", "left").select("node", "rep", "root", F.coalesce("component_id", "rep").alias("component_id"), "copies")
    label = scratch.cut(label.where("copies > 1 OR root IS NOT NULL").select("node", F.coalesce("root", "node").alias("root"), "component_id"), "labels")  # all others are alone
    real = (F.col("n") > 0) & F.col("id").isNotNull()
    return rows.select("id", "k", "node", "n").join(label, "node", "left").select(
        "id", "k", "n", F.when(real, F.col("root")).alias("root"), F.when(F.col("id").isNotNull() & real, F.coalesce("component_id", "id")).when(F.col("n") == 0, F.col("id")).alias("component_id")
    )


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("k"), F.col(text_col).cast("string").alias("text"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75, bloom_bytes: int = BLOOM_BYTES) -> DataFrame:
    """``id_col, n_shingles, component_id`` for each document; links are Jaccard similarities of at least percent / 100."""
    ship(docs.sparkSession, BATCH)
    found = linked(Scratch(docs.sparkSession, "near"), keyed(docs, id_col, text_col), words, percent, bloom_bytes)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75, bloom_bytes: int = BLOOM_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, without those of a component other than one of its smallest id.

    Of rows that share the smallest id one stays (the least by a hash of the text).
    """
    ship(docs.sparkSession, BATCH)
    scratch = Scratch(docs.sparkSession, "near")
    found = scratch.cut(linked(scratch, keyed(docs, id_col, text_col), words, percent, bloom_bytes).where("root IS NOT NULL").select("id", "k", "root", "component_id"), "found")
    scratch.drop("labels")
    first = found.where(F.col("id") == F.col("component_id"))
    stays = first.groupBy("root").agg(F.min("k").alias("k"), F.first("component_id").alias("id"), F.count("*").alias("rows"))
    gone = found.join(stays.select(F.col("id").alias("i"), F.col("k").alias("j"), F.col("root").alias("r")), (F.col("id") == F.col("i")) & (F.col("k") == F.col("j")) & (F.col("root") == F.col("r")), "left_anti")
    names = docs.columns
    rows = docs.select(*[F.col(n).alias(f"c{i}") for i, n in enumerate(names)], F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("k"))
    kept = restrict(rows, ["id", "k"], scratch.cut(gone.select("id", "k"), "gone"), "left_anti")
    twice_ = scratch.cut(stays.where("rows > 1").select("id", "k"), "twice")  # equal rows, or several texts of the id
    plain = lambda df: df.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])
    if twice_.limit(1).isEmpty():
        return plain(kept)
    one = restrict(kept, ["id", "k"], twice_).dropDuplicates(["id", "k"])
    return plain(restrict(kept, ["id", "k"], twice_, "left_anti").unionByName(one))
