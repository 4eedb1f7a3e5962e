"""Operator 2: weighted rendezvous hashing of stable record keys, by built-in functions only.

Each shard i gets the score ``-ln(u) / weight`` with u in (0, 1) hashed from the key and i; the
smallest score wins. Scores do not depend on the other shards, so a further shard only takes
records to itself, about its share of the weight, and no record moves between old shards.

Slots number the records of a shard without gaps. Shards are cut into ``buckets`` hash buckets;
bucket sizes are counted first, so that each bucket is numbered on its own and no shard has to be
sorted in one task. A bucket count table has at most shards x buckets rows.

Edge cases: a null key is a key of its own (all such records meet in one shard, spread over its
buckets by their text); a null text has size 16 and the checksum of no bytes; records with equal
keys share a shard; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Larger shard counts would make the score expression too large to compile.
MAX_SHARDS = 1024


def unit(key: Column, shard: int) -> Column:
    """A number in (0, 1) hashed from the key and a shard's number."""
    h = F.xxhash64(key, F.lit(shard), F.lit("shard"))
    return (F.shiftrightunsigned(h, 11).cast("double") + F.lit(0.5)) / F.lit(float(2**53))


def shard_of(key: Column, weights: list[float]) -> Column:
    """The shard of a key under the given weights (0: takes nothing)."""
    if not 0 < len(weights) <= MAX_SHARDS or any(w < 0 for w in weights) or not any(weights):
        raise ValueError("shards need weights of zero or more, not all zero")
    scores = [F.struct((-F.ln(unit(key, i)) / F.lit(float(w))).alias("s"), F.lit(i).alias("i")) for i, w in enumerate(weights) if w > 0]
    return (F.least(*scores) if len(scores) > 1 else scores[0])["i"].cast("int")


def grown_of(key: Column, weights: list[float], shard: Column, extra: float = 1.0) -> Column:
    """The shard of a key if one more shard of weight ``extra`` is added; reuses the old winner's score."""
    n = len(weights)
    old = F.element_at(F.transform(F.array(*[F.lit(float(w)) for w in weights]), lambda w: w), shard + 1)
    own = -F.ln((F.shiftrightunsigned(F.xxhash64(key, shard, F.lit("shard")), 11).cast("double") + F.lit(0.5)) / F.lit(float(2**53))) / old
    new = -F.ln(unit(key, n)) / F.lit(float(extra))
    return F.when(new < own, F.lit(n)).otherwise(shard).cast("int")


def assign(docs: DataFrame, weights: list[float], id_col: str = "doc_id", text_col: str = "text", buckets: int = 64) -> DataFrame:
    """``id_col, size, text_crc32, law, shard, slot, grown_shard`` for each record.

    Texts are reduced to 40 bytes a record before anything is shuffled.
    """
    key, text = F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        key.alias("k"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), shard_of(key, weights).alias("shard")
    ).withColumn("bucket", F.pmod(F.xxhash64("k", "crc", F.lit("bucket")), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("shard", "bucket").count()
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    place = Window.partitionBy("shard", "bucket").orderBy("k", "crc", "size")
    return (
        rows.withColumn("nth", F.row_number().over(place))
        .join(F.broadcast(starts), ["shard", "bucket"])  # at most shards x buckets rows
        .select(
            F.col("k").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("key").alias("law"), "shard",
            (F.col("start") + F.col("nth") - 1).cast("long").alias("slot"), grown_of(F.col("k"), weights, F.col("shard")).alias("grown_shard"),
        )
    )
