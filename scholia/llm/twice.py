"""A Bloom filter, of a size that does not depend on the input, of the 64-bit values that two rows of a table share.

Each task gathers the values of its rows in chunks. A chunk leaves a row for each bucket of values:
the distinct ones (four bytes each, the bucket tells further bits) and those it met twice with
their counts. A bucket's rows meet in one group, whose size is bounded by the number of buckets,
which follows the input. A value that is not in the filter is held by one row only; the reverse may
be wrong at times, so a saturated filter costs time and never a result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa

from pyspark.sql import DataFrame

SCHEMA = "bucket int, met binary, shared binary, times binary"


def bucket_count(values: int) -> int:
    """About two million values to a bucket, a power of two."""
    return 1 << max(6, min(22, (values // 2_000_000).bit_length()))


def four(v: np.ndarray) -> np.ndarray:
    return (v >> np.uint64(32)).astype("<u4")


class Chunk:
    """Values of rows; the values of one row are distinct."""

    def __init__(self, buckets: int, most: int):
        self.buckets, self.most, self.parts, self.held = buckets, most, [], 0

    def add(self, values: np.ndarray) -> pa.RecordBatch | None:
        """Takes values in, and gives the rows of a full chunk."""
        self.parts.append(values)
        self.held += len(values)
        return self.flush() if self.held >= self.most else None

    def flush(self) -> pa.RecordBatch | None:
        v = np.concatenate(self.parts) if self.parts else np.zeros(0, np.uint64)
        self.parts, self.held = [], 0
        if not len(v):
            return None
        v = np.sort((v >> np.uint64(32)) | ((v & np.uint64(self.buckets - 1)) << np.uint64(32)))  # by bucket, then by value
        first = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
        times = np.diff(np.append(first, len(v)))
        v = v[first]
        value, many = v.astype("<u4"), times > 1
        ends = np.searchsorted(v >> np.uint64(32), np.arange(self.buckets + 1, dtype=np.uint64))
        rows = [(b, value[s:e].tobytes(), value[s:e][many[s:e]].tobytes(), np.minimum(times[s:e][many[s:e]], 65535).astype("<u2").tobytes()) for b, (s, e) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())) if e > s]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *[pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3)]], ["bucket", "met", "shared", "times"])


def places(value: np.ndarray, bucket: np.ndarray, own: int) -> np.ndarray:
    """Three bit numbers of each value in a filter of ``own`` bits a bucket."""
    h = value.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    a, b = h >> np.uint64(32), ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(33)
    return bucket.astype(np.int64)[None] * own + ((a[None] + np.arange(3, dtype=np.uint64)[:, None] * (b | np.uint64(1))[None]) % np.uint64(own)).astype(np.int64)


class Filter:
    """``may_share``: whether a value may be held by two rows; ``level``: 0 if not, else 1, or more for values held often."""

    def __init__(self, packed: np.ndarray, own: int, buckets: int, hot: np.ndarray, levels: np.ndarray):
        self.packed, self.own, self.buckets, self.hot, self.levels = packed, own, buckets, hot, levels

    def may_share(self, v: np.ndarray) -> np.ndarray:
        at = places(four(v), v & np.uint64(self.buckets - 1), self.own)
        out = np.ones(len(v), bool)
        for row in at:
            out &= (self.packed[row >> 3] >> (7 - (row & 7)).astype(np.uint8)) & 1 > 0
        return out

    def level(self, v: np.ndarray) -> np.ndarray:
        out = self.may_share(v).astype(np.uint8)
        some = np.flatnonzero(out)
        if len(self.hot) and len(some):
            key = (four(v[some]).astype(np.uint64) << np.uint64(22)) | (v[some] & np.uint64(self.buckets - 1))
            at = np.minimum(np.searchsorted(self.hot, key), len(self.hot) - 1)
            out[some] += np.where(self.hot[at] == key, self.levels[at], 0).astype(np.uint8)
        return out


def build(blobs: DataFrame, buckets: int, bloom_bytes: int, most_hot: int = 0, often: int = 32) -> Filter:
    """The filter from the chunks' rows (``bloom_bytes`` and at most ``most_hot`` hot values reach the driver).

    Hot values are held by at least ``often`` rows; their level is the logarithm of that number.
    """
    own, each = max(64, bloom_bytes * 8 // buckets) // 8 * 8, -(-most_hot // buckets)

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        v, n = np.unique(np.frombuffer(b"".join(pdf["met"]), "<u4"), return_counts=True)
        shared, times = np.frombuffer(b"".join(pdf["shared"]), "<u4"), np.frombuffer(b"".join(pdf["times"]), "<u2")
        n = n + np.bincount(np.searchsorted(v, shared), times.astype(np.int64) - 1, len(v)).astype(np.int64)
        bits = np.zeros(own, np.uint8)
        twice = v[n > 1]
        bits[places(twice, np.zeros(len(twice), np.int64), own).ravel()] = 1
        top = np.flatnonzero(n >= often)
        top = top[np.lexsort((v[top], -n[top]))][:each]
        return pd.DataFrame({"bucket": [pdf["bucket"].iloc[0]], "bits": [np.packbits(bits).tobytes()], "hot": [v[top].astype("<u4").tobytes()], "level": [np.log2(n[top]).astype(np.uint8).tobytes()]})

    packed = np.zeros(buckets * own // 8, np.uint8)
    hot, levels = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint8)]
    for r in blobs.groupBy("bucket").applyInPandas(fill, "bucket int, bits binary, hot binary, level binary").collect():
        packed[r.bucket * own // 8 : (r.bucket + 1) * own // 8] = np.frombuffer(bytes(r.bits), np.uint8)
        hot.append((np.frombuffer(bytes(r.hot), "<u4").astype(np.uint64) << np.uint64(22)) | np.uint64(r.bucket))
        levels.append(np.frombuffer(bytes(r.level), np.uint8))
    hot, levels = np.concatenate(hot), np.concatenate(levels)
    order = np.argsort(hot)
    return Filter(packed, own, buckets, hot[order], levels[order])
