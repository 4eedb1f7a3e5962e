"""Operator 5: line deduplication with sharded cuckoo filters backed by exact reference tables.

The exact tables are the postings (a row for each document and key) and the reference counts
derived from them: documents holding a key, and the largest of their ids. Keys held by at least
``min_docs`` documents are frequent; each shard of the key space has a cuckoo filter of its
frequent keys. Filters answer "surely not frequent" for most lines, so only lines that pass are
joined with the exact counts, which decide. Documents can be inserted and deleted later: postings
come and go, the counts take in the change alone, and fingerprints of keys that cross the threshold are added to or
removed from the filters, so that deleting what was inserted restores the earlier state.

A key is a line without the ASCII white space at its ends and with A-Z lower-cased; keys shorter
than ``min_chars`` code points are ignored. Keys stand for 128-bit hashes of themselves.

Scale: postings are 16 bytes and an id for each eligible line; reference counts are partial
aggregates, so a line held by a third of all documents is one row for each task; the join with the
counts is a shuffle join that the adaptive plan may split or broadcast. Filters are broadcast only
up to ``max_filter_bytes``; beyond, postings go to the filter of their shard, the postings of a shard in
parts of about ``PROBE_ROWS``, each with a copy of the filter.

Edge cases: a null or empty text is one empty line; a row is a document, rows with one id count
each and all of them keep what the largest id keeps; null ids come before all others; an empty
table gives an empty result; texts of any length are read whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import MAX_BROADCAST_IDS, WS_BYTES, Scratch, ship

KEYS_PER_SHARD, MAX_FILTER_BYTES, MAX_BROADCAST_DROPS, PROBE_ROWS = 40_000, 32 << 20, 400_000, 1_000_000


class Full(Exception):
    """No room for a fingerprint: the filter has to be built anew, larger, from the exact table."""


class Cuckoo:
    """Fingerprints of 16 bits, four to a bucket, each key in one of two buckets."""

    SLOTS, KICKS = 4, 500

    def __init__(self, buckets: int = 16, table: np.ndarray | None = None):
        self.table = np.zeros((buckets, self.SLOTS), np.uint16) if table is None else table
        self.mask = np.uint64(len(self.table) - 1)

    @classmethod
    def of(cls, k1: np.ndarray, k2: np.ndarray, buckets: int = 16) -> Cuckoo:
        while buckets * cls.SLOTS * 0.85 < len(k1):
            buckets *= 2
        while True:
            try:
                out = cls(buckets)
                out.insert(k1, k2)
                return out
            except Full:
                buckets *= 2

    def places(self, k1: np.ndarray, k2: np.ndarray):
        """Fingerprint and both buckets; the second from the first and the fingerprint, and back."""
        fp = (k2.astype(np.uint64) & np.uint64(0xFFFF)).astype(np.uint16)
        fp[fp == 0] = 1
        first = k1.astype(np.uint64) & self.mask
        return fp, first, self.other(first, fp)

    def other(self, bucket, fp):
        return (bucket ^ ((fp.astype(np.uint64) * np.uint64(0x5BD1E995)) >> np.uint64(7))) & self.mask

    def holds(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        fp, a, b = self.places(k1, k2)
        return (self.table[a] == fp[:, None]).any(1) | (self.table[b] == fp[:, None]).any(1)

    def insert(self, k1: np.ndarray, k2: np.ndarray) -> None:
        rng = np.random.default_rng(len(self.table))
        for fp, a, b in zip(*self.places(k1, k2)):
            for at in (a, b):
                free = np.flatnonzero(self.table[at] == 0)
                if len(free):
                    self.table[at, free[0]] = fp
                    break
            else:
                at = b
                for _ in range(self.KICKS):
                    slot = int(rng.integers(self.SLOTS))
                    fp, self.table[at, slot] = self.table[at, slot], fp
                    at = self.other(at, fp)
                    free = np.flatnonzero(self.table[at] == 0)
                    if len(free):
                        self.table[at, free[0]] = fp
                        break
                else:
                    raise Full

    def delete(self, k1: np.ndarray, k2: np.ndarray) -> None:
        """Only keys that were inserted may be deleted."""
        for fp, a, b in zip(*self.places(k1, k2)):
            for at in (a, b):
                hit = np.flatnonzero(self.table[at] == fp)
                if len(hit):
                    self.table[at, hit[0]] = 0
                    break
            else:
                raise KeyError("the filter does not hold this key")

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Cuckoo:
        return cls(table=np.frombuffer(data, np.uint16).reshape(-1, cls.SLOTS).copy())


def line_key(line: bytes, min_chars: int) -> bytes | None:
    key = line.strip(WS_BYTES).lower()
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key)


def _id_type(df: DataFrame, col: str) -> str:
    return df.schema[col].dataType.simpleString()


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40) -> DataFrame:
    """``k1, k2, doc``: the distinct keys of each document. A map, no shuffle."""
    ship(docs.sparkSession)

    def run(batches):
        for b in batches:
            keys, rows = [], []
            for i, text in enumerate(b.column("text").cast(pa.binary()).to_pylist()):
                own = {k for x in (text or b"").split(b"\n") if len(x) >= min_chars and (k := line_key(x, min_chars))}
                keys += own
                rows += [i] * len(own)
            k = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(k[:, 0]), pa.array(k[:, 1]), b.column("doc").take(pa.array(rows, pa.int64()))], ["k1", "k2", "doc"])

    return docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"k1 long, k2 long, doc {_id_type(docs, id_col)}")


def reference_counts(posts: DataFrame) -> DataFrame:
    """``k1, k2, n_docs, max_doc``."""
    return posts.groupBy("k1", "k2").agg(F.count("*").alias("n_docs"), F.max("doc").alias("max_doc"))


def insert(posts: DataFrame, docs: DataFrame, **columns) -> DataFrame:
    """Postings with further documents."""
    return posts.unionByName(postings(docs, **columns))


def delete(posts: DataFrame, ids: DataFrame) -> DataFrame:
    """Postings without the documents whose ids are in the one column of ``ids``."""
    return posts.join(ids.select(F.col(ids.columns[0]).alias("_scholia_id")).distinct(), F.col("doc").eqNullSafe(F.col("_scholia_id")), "left_anti")


def held_by(posts: DataFrame, ids: DataFrame) -> DataFrame:
    """The postings that ``delete`` takes away."""
    return posts.join(ids.select(F.col(ids.columns[0]).alias("_scholia_id")).distinct(), F.col("doc").eqNullSafe(F.col("_scholia_id")), "left_semi")


def updated_counts(counts: DataFrame, posts: DataFrame, added: DataFrame | None = None, removed: DataFrame | None = None) -> DataFrame:
    """``reference_counts(posts)`` from the counts before the postings ``added`` came and ``removed`` went.

    Only the change is aggregated. Postings are read again just for keys that lost their largest id
    and keep others; keys without a change pass through, keys without a document go.
    """
    parts = [x.select("k1", "k2", F.lit(sign).alias("sign"), F.col("doc") if sign > 0 else F.lit(None).alias("doc"), F.col("doc").alias("gone") if sign < 0 else F.lit(None).alias("gone")) for x, sign in ((added, 1), (removed, -1)) if x is not None]
    if not parts:
        return counts
    key = ["k1", "k2"]
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    change = both.groupBy(key).agg(F.sum("sign").alias("more"), F.max("doc").alias("up"), F.max("gone").alias("gone"))
    met = counts.join(change, key)
    moved = met.select(
        *key, (F.col("n_docs") + F.col("more")).alias("n_docs"), F.greatest("max_doc", "up").alias("max_doc"),
        (F.col("gone").eqNullSafe(F.col("max_doc")) & F.col("gone").isNotNull() & (F.col("up").isNull() | (F.col("up") < F.col("max_doc")))).alias("stale"),
    ).where("n_docs > 0")
    fresh = change.join(met.select(*key), key, "left_anti").where("more > 0").select(*key, F.col("more").alias("n_docs"), F.col("up").alias("max_doc"))
    stale = moved.where("stale").select(*key, "n_docs")
    again = posts.join(stale, key).groupBy(key).agg(F.first("n_docs").alias("n_docs"), F.max("doc").alias("max_doc"))
    rest = counts.join(change.select(*key), key, "left_anti")
    return rest.unionByName(moved.where("NOT stale").drop("stale")).unionByName(again).unionByName(fresh)


def _sharded(keys: DataFrame, shards: int) -> DataFrame:
    return keys.withColumn("shard", F.pmod(F.shiftright("k2", 20), F.lit(shards)).cast("int"))


def filters(frequent: DataFrame, shards: int) -> DataFrame:
    """``shard, filter`` of the keys in ``frequent(k1, k2)``; a shard has about KEYS_PER_SHARD of them."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        f = Cuckoo.of(pdf["k1"].to_numpy(), pdf["k2"].to_numpy())
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "filter": [f.to_bytes()]})

    return _sharded(frequent.select("k1", "k2"), shards).groupBy("shard").applyInPandas(build, "shard int, filter binary")


def update_filters(old: DataFrame, shards: int, before: DataFrame, after: DataFrame) -> DataFrame:
    """Filters after the frequent keys changed from ``before`` to ``after``: only changed shards are touched.

    A filter that runs full is built anew from the exact table of its shard.
    """
    was, now = (_sharded(x.select("k1", "k2"), shards) for x in (before, after))
    on = ["k1", "k2", "shard"]
    changes = now.join(was, on, "left_anti").withColumn("add", F.lit(True)).unionByName(was.join(now, on, "left_anti").withColumn("add", F.lit(False)))

    def apply(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        f = Cuckoo.from_bytes(left["filter"].iloc[0]) if len(left) else Cuckoo(1 << max(4, int(np.ceil(np.log2(max(1, len(right) / 3.4))))))
        gone, new = right[~right["add"].astype(bool)], right[right["add"].astype(bool)]
        f.delete(gone["k1"].to_numpy(), gone["k2"].to_numpy())
        try:
            f.insert(new["k1"].to_numpy(), new["k2"].to_numpy())
            full = False
        except Full:
            full = True
        shard = (left if len(left) else right)["shard"].iloc[0]
        return pd.DataFrame({"shard": [shard], "filter": [None if full else f.to_bytes()]})

    out = old.groupBy("shard").cogroup(changes.groupBy("shard")).applyInPandas(apply, "shard int, filter binary")
    anew = filters(now.join(out.where("filter IS NULL").select("shard"), "shard", "left_semi"), shards)
    return out.where("filter IS NOT NULL").unionByName(anew)


def frequent_keys(scratch: Scratch, posts: DataFrame, min_docs: int) -> DataFrame:
    return scratch.cut(reference_counts(posts).where(F.col("n_docs") >= min_docs), "frequent")


def probe_by_shard(posts: DataFrame, table: DataFrame, shards: int, rows: int = PROBE_ROWS) -> DataFrame:
    """The postings that the filters of ``table(shard, filter)`` let pass. No filter is collected or broadcast."""
    own = _sharded(posts, shards)
    parts = own.groupBy("shard").agg(F.ceil(F.count("*") / rows).cast("int").alias("parts")).join(table.select("shard"), "shard")
    parts = F.broadcast(parts) if shards <= MAX_BROADCAST_IDS else parts  # a row a shard
    left = own.join(parts, "shard").withColumn("part", F.pmod(F.xxhash64("doc", "k1"), F.col("parts")).cast("int")).drop("parts")
    right = table.join(parts, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "filter")

    def probe(lines: pa.Table, held: pa.Table) -> pa.Table:
        lines = lines.select(["k1", "k2", "doc"])
        if not lines.num_rows or not held.num_rows:
            return lines.slice(0, 0)
        f = Cuckoo.from_bytes(held.column("filter")[0].as_py())
        return lines.filter(pa.array(f.holds(lines.column("k1").to_numpy(), lines.column("k2").to_numpy())))

    key = ["shard", "part"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(probe, posts.schema)


def drops(scratch: Scratch, posts: DataFrame, min_docs: int, max_filter_bytes: int | None = None) -> DataFrame:
    """``doc, k1, k2``: the keys that each document loses."""
    spark = posts.sparkSession
    frequent = frequent_keys(scratch, posts, min_docs)
    n = frequent.count()
    shards = max(1, -(-n // KEYS_PER_SHARD))
    if n * 10 <= (MAX_FILTER_BYTES if max_filter_bytes is None else max_filter_bytes):  # a filter has at most 10 bytes a key
        held = spark.sparkContext.broadcast({r.shard: bytes(r.filter) for r in filters(frequent, shards).collect()})

        def probe(batches):
            known = {s: Cuckoo.from_bytes(f) for s, f in held.value.items()}
            for b in batches:
                k1, k2 = b.column("k1").to_numpy(), b.column("k2").to_numpy()
                shard = (k2 >> 20) % shards
                keep = np.zeros(len(k1), bool)
                for s, f in known.items():
                    own = np.flatnonzero(shard == s)
                    keep[own] = f.holds(k1[own], k2[own])
                yield b.filter(pa.array(keep))

        posts = posts.mapInArrow(probe, posts.schema)
    else:
        posts = probe_by_shard(posts, scratch.cut(filters(frequent, shards), "filters"), shards)
    return posts.join(frequent, ["k1", "k2"]).where(~F.col("doc").eqNullSafe(F.col("max_doc"))).select("doc", "k1", "k2")


def rewrite(docs: DataFrame, dropped: DataFrame, columns: list[str], id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """``columns`` as ``c0, c1, ...``, then ``text, n_lines, n_dropped, kept_sha256`` of each document.

    Dropped keys are counted: few are broadcast, so that texts stay where they are; many are joined.
    """
    ship(docs.sparkSession)
    lists = dropped.groupBy("doc").agg(F.collect_set(F.struct("k1", "k2")).alias("keys"))
    if dropped.limit(MAX_BROADCAST_DROPS + 1).count() <= MAX_BROADCAST_DROPS:
        lists = F.broadcast(lists)
    kinds = [docs.schema[c].dataType.simpleString() for c in columns]
    rows = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)], F.col(id_col).alias("own"), F.col(text_col).cast("string").alias("text"))
    rows = rows.join(lists, F.col("own").eqNullSafe(F.col("doc")), "left").select(*[f"c{i}" for i in range(len(columns))], "text", "keys")

    def run(batches):
        for b in batches:
            texts, lines, gone, digests = [], [], [], []
            for text, keys in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("keys").to_pylist()):
                parts = (text or b"").split(b"\n")
                lines.append(len(parts))
                if keys:
                    bad = {np.array([k["k1"], k["k2"]], np.int64).tobytes() for k in keys}
                    parts = [x for x in parts if len(x) < min_chars or line_key(x, min_chars) not in bad]
                gone.append(lines[-1] - len(parts))
                texts.append(b"\n".join(parts))
                digests.append(hashlib.sha256(texts[-1]).hexdigest())
            new = [pa.array(texts, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays([b.column(f"c{i}") for i in range(len(columns))] + new, [f"c{i}" for i in range(len(columns))] + ["text", "n_lines", "n_dropped", "kept_sha256"])

    return rows.mapInArrow(run, ", ".join([f"c{i} {k}" for i, k in enumerate(kinds)] + ["text string", "n_lines long", "n_dropped long", "kept_sha256 string"]))


def dedup(docs: DataFrame, columns: list[str], id_col: str = "doc_id", text_col: str = "text", min_docs: int = 5, min_chars: int = 40) -> DataFrame:
    """``rewrite`` of all documents against their own line counts."""
    scratch = Scratch(docs.sparkSession, "lines")
    posts = scratch.cut(postings(docs, id_col, text_col, min_chars), "postings")
    lost = scratch.cut(drops(scratch, posts, min_docs), "drops")
    scratch.drop("postings", "frequent", "filters")
    return rewrite(docs, lost, columns, id_col, text_col, min_chars)


def dedup_report(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    return dedup(docs, [id_col], id_col, **options).select(F.col("c0").alias(id_col), "n_lines", "n_dropped", "kept_sha256")


def dedup_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """All rows and columns of ``docs``, with the lines gone from the texts."""
    names = docs.columns
    others = [n for n in names if n != text_col]
    out = dedup(docs, others, id_col, text_col, **options)
    return out.select(*[F.col("text" if n == text_col else f"c{others.index(n)}").alias(n) for n in names])
