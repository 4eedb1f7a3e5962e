"""Operator 1: removal of repeated passages by suffix arrays.

A byte goes if it lies in a string of ``length`` bytes (a window) that also starts in a document
of smaller id. Windows are judged on the input, and never cross documents.

1. Later copies of a whole text need no search: all their windows start in the first copy.
2. Each window belongs to the shard named by its minimizer, the least hash among its grams of
   ``GRAM`` bytes, so equal windows meet in one shard. Neighbouring windows of one minimizer form a
   run, whose bytes are kept once. Minimizers met in two documents or more are found first, by
   exchanging their hashes (four bytes each); a Bloom filter of fixed size tells which runs can
   matter. Runs of equal bytes are one class with its smallest and largest id.
3. A shard's classes are cut into blocks. Each block gets a suffix array by Larsson-Sadakane
   refinement (only groups still unsorted are refined, doubling the depth until it covers a
   window), whose last ranks tell the groups of equal windows. Windows of one group take the
   smallest id; windows of different blocks are merged by binary search. Common prefixes by Kasai's
   recurrence, run in lanes, say the same and check the ranks in the tests.
4. Documents are joined with what their runs lost; overlapping intervals are merged, and the bytes
   left are put together.

Scale: no shard grows with one minimizer: a minimizer of more than ``HOT_CLASSES`` classes, or
``HOT_BYTES`` of them, is taken apart into single windows, dealt by their hashes. Passages held by very many documents are one
class, formed by partial aggregates. The filter's size is fixed (``bloom_bytes``), so on inputs
that saturate it more runs are shuffled, with the same result; raise it with the executors.

Edge cases: a null text is empty; texts shorter than a window lose nothing; rows with a null id
neither lose bytes nor make others lose any; rows with equal ids do not affect one another, and are
told apart by their texts; repeated rows are documents each; texts of any length are read whole (runs are cut at ``RUN``
windows); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholia.llm import twice
from scholia.llm.common import Scratch, free_shuffles, restrict, ship

GRAM, RUN, LANES, PIECE = 20, 8192, 4096, 1 << 14
BLOOM_BYTES, CHUNK, BLOCK, SHARD, HOT_CLASSES, HOT_BYTES = 32 << 20, 2_000_000, 1 << 20, 768 << 10, 20_000, 16 << 20
MAX_BROADCAST_BYTES, MAX_MARKS = 16 << 20, 250_000
TABLE = np.random.default_rng(11).integers(1 << 62, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _least_hashes(buf: np.ndarray, length: int) -> np.ndarray:
    h, span, parts = TABLE[buf], 1, {}
    while span <= GRAM:
        parts[span] = h
        if 2 * span > GRAM:
            break
        mix = h[span:] >> np.uint64(29)
        mix ^= h[span:]
        h = h[:-span] * np.uint64(0x9E3779B97F4A7C15)
        h += mix
        span *= 2
    gram, done = None, 0
    for s in sorted(parts, reverse=True):
        if GRAM - done >= s:
            piece = parts[s][done:]
            gram = piece if gram is None else gram[: len(piece)] * np.uint64(0xBF58476D1CE4E5B9) + (piece ^ (piece >> np.uint64(31)))
            done += s
    gram = gram[: len(buf) - GRAM + 1]
    gram = (gram ^ (gram >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    gram ^= gram >> np.uint64(30)
    wide, least, span = length - GRAM + 1, gram, 1
    while 2 * span <= wide:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    return np.minimum(least[: len(gram) - wide + 1], least[wide - span :][: len(gram) - wide + 1]) if wide > span else least


def minimizers(buf: np.ndarray, length: int) -> np.ndarray:
    """For each start of a window in ``buf`` the least hash of its grams (long buffers: at least ``length``).

    Made in pieces that stay in the processor's cache.
    """
    n = len(buf) - length + 1
    out = np.empty(n, np.uint64)
    for at in range(0, n, PIECE):
        out[at : at + PIECE] = _least_hashes(buf[at : at + PIECE + length - 1], length)
    return out


def runs(texts: list[bytes], length: int):
    """``doc, start, windows, value`` arrays of the runs of some texts, and their bytes joined."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = b"".join(texts)
    z = np.zeros(0, np.int64)
    long = np.flatnonzero(sizes >= length)
    if not len(long):
        return z, z, z, z.astype(np.uint64), data
    least = minimizers(np.frombuffer(data, np.uint8), length)
    begin = (np.cumsum(sizes) - sizes)[long]
    end = begin + sizes[long] - length + 1  # behind the last window
    cuts = [np.arange(a + RUN, b, RUN) for a, b in zip(begin.tolist(), end.tolist()) if b - a > RUN]
    edge = np.zeros(len(least) + 1, bool)
    np.not_equal(least[1:], least[:-1], out=edge[1:-1])
    for at in (begin, end, *cuts):
        edge[at] = True
    edge = np.flatnonzero(edge)  # also in windows across two texts, which are left out
    first, windows = edge[:-1], np.diff(edge)
    doc = np.searchsorted(begin, first, "right") - 1
    own = (doc >= 0) & (first < end[doc])
    first, windows, doc = first[own], windows[own], doc[own]
    return long[doc], first - begin[doc], windows, least[first], data


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))


def shared_minimizers(docs: DataFrame, length: int, bloom_bytes: int) -> twice.Filter:
    """The filter of the minimizers that two texts share."""
    total = docs.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    buckets = twice.bucket_count(int(total) // 16)

    def run(batches):
        chunk = twice.Chunk(buckets, CHUNK)
        for b in batches:
            doc, _, _, value, _ = runs(b.column("text").to_pylist(), length)
            ends = np.flatnonzero(np.append(doc[1:] != doc[:-1], True)) + 1 if len(doc) else ()
            at = 0
            for end in ends:
                if (full := chunk.add(np.unique(value[at:end]))) is not None:
                    yield full
                at = end
        if (rest := chunk.flush()) is not None:
            yield rest

    return twice.build(docs.select("text").mapInArrow(run, twice.SCHEMA), buckets, bloom_bytes)


def occurrences(docs: DataFrame, length: int, held) -> DataFrame:
    """``value, c1, c2, id, k, start, windows, run`` of the runs that the filter lets pass."""

    def run(batches):
        for b in batches:
            ids, texts = b.column("id").to_numpy(), b.column("text").to_pylist()
            doc, start, windows, value, data = runs(texts, length)
            hit = np.flatnonzero(held.value.may_share(value))
            doc, start, windows, value = doc[hit], start[hit], windows[hit], value[hit]
            begin = np.cumsum([0] + [len(t) for t in texts])[doc] + start
            pieces = [data[a : a + n] for a, n in zip(begin.tolist(), (windows + length - 1).tolist())]
            names = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, pieces)), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(value.view(np.int64)), pa.array(names[:, 0].copy()), pa.array(names[:, 1].copy()), pa.array(ids[doc]), b.column("k").take(pa.array(doc)), pa.array(start.astype(np.int32)), pa.array(windows.astype(np.int32)), pa.array(pieces, pa.binary())],
                ["value", "c1", "c2", "id", "k", "start", "windows", "run"])

    return docs.mapInArrow(run, "value long, c1 long, c2 long, id long, k long, start int, windows int, run binary")


def words_at(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each start as a number (zeros beyond the end)."""
    n = len(buf)
    pad = np.zeros(n + 8, np.uint8)
    pad[:n] = buf
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | pad[i : i + n]
    return key


def ranked(buf: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of ``buf`` in the order of their first ``depth`` bytes, and each start's rank: equal ranks are equal
    bytes (Larsson-Sadakane refinement from eight bytes).

    A group of equal starts carries the place of its last member as rank. A round sorts only the
    members of groups of two or more, by the rank of what follows at the depth reached.
    """
    n, key = len(buf), words_at(buf)
    sa = np.argsort(key)
    rank = np.zeros(n + depth, np.int64)  # what lies beyond the end ranks before all else
    open_ = np.arange(n)  # places in sa that are not settled
    reach, have = 0, 8
    sorted_key = key[sa]
    while True:
        new = np.ones(len(open_), bool)
        np.not_equal(sorted_key[1:], sorted_key[:-1], out=new[1:])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(open_)) - 1
        rank[sa[open_]] = np.repeat(open_[last] + 1, last - first + 1)
        single = new.copy()
        single[:-1] &= new[1:]
        open_ = open_[~single]
        if have >= depth or not len(open_):
            return sa, rank[:n]
        reach = min(have, depth - have)
        at = sa[open_]
        pair = (rank[at].astype(np.uint64) << np.uint64(32)) | rank[at + reach].astype(np.uint64)  # of starts below 2 ** 32
        order = np.argsort(pair)
        sa[open_], sorted_key = at[order], pair[order]
        have += reach


def suffix_array(buf: np.ndarray, depth: int) -> np.ndarray:
    """Starts of ``buf`` in the order of their first ``depth`` bytes."""
    return ranked(buf, depth)[0]


def common_prefixes(buf: np.ndarray, sa: np.ndarray, depth: int) -> np.ndarray:
    """Length, up to ``depth``, that each start in ``sa`` shares with the one before it.

    Kasai's recurrence: in text order the length falls by at most one from a start to the next,
    unless it was ``depth``: such neighbours are ordered no further, so the next start is compared
    anew. Stretches of the text are walked side by side, one lane each.
    """
    n, key = len(buf), words_at(buf)
    other = np.full(n, n, np.int64)  # the start before, by text position
    other[sa[1:]] = sa[:-1]
    lanes = min(LANES, n) or 1
    steps = -(-n // lanes)
    out, h = np.zeros(n, np.int16), np.zeros(lanes, np.int64)
    start = np.arange(lanes) * steps
    for k in range(steps):
        i = start + k
        on = np.flatnonzero(i < n)
        i, h, start = i[on], h[on], start[on]
        h = np.where(h < depth, np.maximum(h - 1, 0), 0)
        j = other[i]
        h[j == n] = 0
        for stride, same in ((8, key), (1, buf)):
            go = np.flatnonzero(j < n)
            while len(go):
                a, b = i[go] + h[go], j[go] + h[go]
                fit = (h[go] + stride <= depth) & (np.maximum(a, b) + stride <= n)
                go, a, b = go[fit], a[fit], b[fit]
                go = go[same[a] == same[b]]
                h[go] += stride
        out[i] = h
    return out[sa]


def block_lows(texts: list[bytes], low: np.ndarray, length: int, several: bool):
    """For a block: text and offset of every window, in order, its place among the distinct windows, their smallest
    ids, and (of several blocks) the distinct windows in order."""
    buf = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    offset = np.arange(len(buf)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    _, rank = ranked(buf, length)
    pos = np.flatnonzero(offset + length <= np.repeat(sizes, sizes))
    owner, offset, rank = owner[pos], offset[pos], rank[pos]
    used = np.zeros(len(buf) + 1, np.int64)
    used[rank] = 1
    member = (np.cumsum(used) - 1)[rank]
    least = np.full(int(used.sum()), np.iinfo(np.int64).max)
    np.minimum.at(least, member, low[owner])
    windows = None
    if several:
        first = np.zeros(len(least), np.int64)
        first[member] = pos
        windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(buf, length)[first]).view(f"S{length}").ravel()
    return owner, offset, member, least, windows


def shard_losses(texts: list[bytes], low: np.ndarray, high: np.ndarray, length: int):
    """``text, from, to, low``: stretches of windows whose smallest id is below the largest id of their text's class."""
    cuts, size = [0], 0
    for i, t in enumerate(texts):
        size += len(t)
        if size > BLOCK and i > cuts[-1]:
            cuts.append(i)
            size = len(t)
    cuts.append(len(texts))
    blocks = [block_lows(texts[a:b], low[a:b], length, len(cuts) > 2) for a, b in zip(cuts[:-1], cuts[1:])]
    least = [b[3].copy() for b in blocks]
    for x in range(len(blocks)):
        for y in range(x):
            mine, theirs = blocks[x][4], blocks[y][4]
            at = np.minimum(np.searchsorted(theirs, mine), len(theirs) - 1)
            same = np.flatnonzero(theirs[at] == mine)
            both = np.minimum(least[x][same], least[y][at[same]])
            least[x][same] = both
            least[y][at[same]] = both
    # Blocks before x already agree on each window they share, so one round settles all.
    out = []
    for (owner, offset, member, _, _), lows, base in zip(blocks, least, cuts):
        value = lows[member]
        lost = value < high[base + owner]
        owner, offset, value = owner[lost], offset[lost], value[lost]
        if len(owner):
            new = np.ones(len(owner), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (offset[1:] != offset[:-1] + 1) | (value[1:] != value[:-1])
            first = np.flatnonzero(new)
            last = np.append(first[1:] - 1, len(owner) - 1)
            out.append((owner[first] + base, offset[first], offset[last], value[first]))
    z = np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (z, z, z, z)


def losses(classes: DataFrame, length: int, shards: int) -> DataFrame:
    """``c1, c2, a, b, low`` for classes ``value, c1, c2, low, high, run``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        text, a, b, low = shard_losses(pdf["run"].tolist(), pdf["low"].to_numpy(), pdf["high"].to_numpy(), length)
        return pd.DataFrame({"c1": pdf["c1"].to_numpy()[text], "c2": pdf["c2"].to_numpy()[text], "a": a.astype(np.int32), "b": b.astype(np.int32), "low": low})

    return classes.withColumn("shard", F.pmod(F.xxhash64("value"), F.lit(shards))).groupBy("shard").applyInPandas(run, "c1 long, c2 long, a int, b int, low long")


def removed_spans(docs: DataFrame, scratch: Scratch, length: int, bloom_bytes: int) -> DataFrame:
    """``id, k, spans`` (array of start and end bytes, in order) for first copies ``id, k, text`` that lose bytes."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(shared_minimizers(docs, length, bloom_bytes))
    free_shuffles(spark)
    # The runs are made three times (a map over the texts) rather than kept with their bytes.
    raw = occurrences(docs, length, held)
    classes = lambda rows: rows.groupBy("c1", "c2").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.first("value").alias("value"), F.first("run").alias("run"))
    known = scratch.cut(classes(raw), "classes")
    free_shuffles(spark)
    found = scratch.cut(raw.select("c1", "c2", "id", "k", "start"), "runs")
    hot = known.groupBy("value").agg(F.count("*").alias("c"), F.sum(F.length("run")).alias("b")).where((F.col("c") > HOT_CLASSES) | (F.col("b") > HOT_BYTES)).select("value")
    if not hot.limit(1).isEmpty():
        hot = scratch.cut(hot, "hot")
        piece = F.expr(f"substring(run, w + 1, {length})")
        single = raw.join(hot, "value", "left_semi").withColumn("w", F.explode(F.sequence(F.lit(0), F.col("windows") - 1)))
        single = single.select("id", "k", (F.col("start") + F.col("w")).alias("start"), piece.alias("run")).select(
            F.xxhash64("run").alias("value"), F.xxhash64("run").alias("c1"), F.conv(F.substring(F.md5("run"), 1, 15), 16, 10).cast("long").alias("c2"), "id", "k", "start", "run")
        known = known.join(hot, "value", "left_anti").unionByName(scratch.cut(classes(single), "classes-single"))
        found = found.unionByName(scratch.cut(single.select("c1", "c2", "id", "k", "start"), "single"))
        free_shuffles(spark)
    size = known.agg(F.sum(F.length("run"))).collect()[0][0] or 0
    lost = scratch.cut(losses(known, length, max(1, -(-int(size) // SHARD))), "losses")
    free_shuffles(spark)
    gone = found.select("c1", "c2", "id", "k", "start").join(lost, ["c1", "c2"]).where("low < id").select("id", "k", (F.col("start") + F.col("a")).alias("s"), (F.col("start") + F.col("b") + length).alias("e"))
    order = Window.partitionBy("id", "k").orderBy("s", "e")
    far = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = gone.withColumn("new", F.when(far >= F.col("s"), 0).otherwise(1)).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy("id", "k", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    spans = scratch.cut(merged.groupBy("id", "k").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("spans")), "spans")
    scratch.drop("classes", "classes-single", "runs", "single", "losses")
    return spans


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, bloom_bytes: int = BLOOM_BYTES) -> DataFrame:
    """``id_col, n_bytes, n_removed, n_spans, kept_sha256, kept`` (the bytes left) for each document."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "suffix")
    rows = _texts(docs, id_col, text_col)
    names = scratch.cut(rows.where("id IS NOT NULL").select("id", F.octet_length("text").alias("n"), F.md5("text").alias("h"), F.xxhash64("text").alias("x")), "names")
    # Rows are told apart by (id, k): k is 0, or a hash of the text where an id has several texts.
    several = scratch.cut(names.groupBy("id").agg(F.min("x").alias("a"), F.max("x").alias("b")).where("a != b").select("id"), "several")
    if several.limit(1).isEmpty():
        key = lambda df, x: df.withColumn("k", F.lit(0).cast("long"))
    else:
        few = several.limit(MAX_MARKS + 1).count() <= MAX_MARKS
        marks = several.select(F.col("id").alias("_id"), F.lit(True).alias("_many"))
        key = lambda df, x: df.join(F.broadcast(marks) if few else marks, F.col("id") == F.col("_id"), "left").withColumn("k", F.when(F.col("_many"), x).otherwise(F.lit(0))).drop("_id", "_many")
    rows = key(rows, F.xxhash64("text"))
    first = scratch.cut(names.where(F.col("n") >= length).groupBy("h").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("h", "first"), "first")
    later = scratch.cut(key(names, F.col("x")).join(first, "h").where("id > first").select("id", "k").distinct(), "later")
    scratch.drop("names")
    long = rows.where(F.col("id").isNotNull() & (F.octet_length("text") >= length))
    spans = removed_spans(restrict(long, ["id", "k"], later, "left_anti").select("id", "k", "text"), scratch, length, bloom_bytes)
    bound = spans.agg(F.sum(F.size("spans") * 16 + 64)).collect()[0][0] or 0
    few = bound <= MAX_BROADCAST_BYTES and later.count() <= MAX_MARKS
    marks = spans.select(F.col("id").alias("i"), F.col("k").alias("j"), "spans", F.lit(False).alias("whole")).unionByName(later.select(F.col("id").alias("i"), F.col("k").alias("j"), F.lit(None).alias("spans"), F.lit(True).alias("whole")))
    out = rows.join(F.broadcast(marks) if few else marks, (F.col("id") == F.col("i")) & (F.col("k") == F.col("j")), "left").select("id", "text", "spans", F.coalesce("whole", F.lit(False)).alias("whole"))

    def run(batches):
        for b in batches:
            counts, kept = [], []
            for text, spans, whole in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), b.column("whole").to_pylist()):
                cuts = [(0, len(text))] if whole else [(s["s"], s["e"]) for s in spans or ()]
                at, parts = 0, []
                for s, e in cuts:
                    parts.append(text[at:s])
                    at = e
                kept.append(b"".join(parts) + text[at:])
                counts.append((len(text), len(text) - len(kept[-1]), len(cuts)))
            digests = [hashlib.sha256(x).hexdigest() for x in kept]
            yield pa.RecordBatch.from_arrays([b.column("id"), *[pa.array([c[i] for c in counts], pa.int64()) for i in range(3)], pa.array(digests, pa.string()), pa.array(kept, pa.binary())], [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return out.mapInArrow(run, f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
