"""Operator 8: mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Targets: sources share the words of all documents by weight; a source's target stops at
``max_copies`` times its words, and the excess is shared again by weight among the others until
no source is above.

Quotas: each source's documents fall into hash blocks. A source's quota is the number of block
copies that its target asks for: every block floor(target / words) times, then once more as many
as reach the rest. A tree splits the exact quotas of all sources between the two halves of its
shards by one multivariate-hypergeometric draw at each node. A leaf's quotas draw the next blocks
of each source's seeded permutation, pass by pass, so the runs of the leaves are disjoint; what no
leaf draws is not taken. The last block copy of a source is taken document by document, and the
last document in part, so that the words taken equal the target to a word. Inside a shard the
copies stand in a seeded order of their own.

Draws depend on the seed and the block tables alone, so reruns agree. The driver holds a row for
each source (at most ``MAX_SOURCES``) and shard; block tables stay distributed, blocks hold about
``BLOCK_ROWS`` documents, and documents are never sorted by source, but for the one block of each
source that is taken in part. Tables that are broadcast are counted first.

Edge cases: a null source is a source of its own, last in order; null and empty texts have size 0
and are taken 0 times; sources without words have target 0; repeated rows are documents each, and
rows equal in id and text stand in any order among themselves; no documents give no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholia.llm.common import Scratch

#: The weights of sources in order, repeating.
WEIGHTS = (5, 2, 1)
MAX_SOURCES, BLOCKS, MAX_BLOCKS, BLOCK_ROWS, MAX_COPIES, SHARDS = 1_000_000, 256, 1 << 20, 1024, 3, 16
MAX_LEAVES, MAX_BROADCAST_ROWS, WORDS_A_TASK = 20_000_000, 100_000, 20_000_000


def targets(sizes: list[int], weights: list[float], most: float = MAX_COPIES) -> list[float]:
    """Shares of the total by weight, none above ``most`` times its size; the excess is shared again."""
    size, w = np.array(sizes, float), np.array(weights, float)
    out, free, left = np.zeros(len(size)), size > 0, float(size.sum())
    while free.any() and left > 0:
        share = left * w / w[free].sum()
        over = free & (share >= most * size)
        if not over.any():
            out[free] = share[free]
            break
        out[over] = most * size[over]
        left -= float(out[over].sum())
        free &= ~over
    return out.tolist()


def deal(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Quotas of block copies by source to a table shards x sources, the shards' totals as even as can be."""
    if shards == 1:
        return quotas[None, :]
    left = shards // 2
    total = int(quotas.sum())
    take = total * left // shards
    first = rng.multivariate_hypergeometric(quotas, take, method="marginals") if len(quotas) > 1 else np.array([take])
    return np.vstack([deal(first, left, rng), deal(quotas - first, shards - left, rng)])


def measured(docs: DataFrame, id_col: str, text_col: str, source_col: str, keep: dict[str, str] | None = None) -> DataFrame:
    """``id, source, size, k`` (a hash of the text), and the columns of ``keep`` under the names given there."""
    text = F.col(text_col).cast("string")
    size = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), F.xxhash64(text).alias("k"), *[F.col(c).alias(n) for c, n in (keep or {}).items()])


def blocked(rows: DataFrame, blocks: int) -> DataFrame:
    return rows.withColumn("block", F.pmod(F.xxhash64("id", "k", F.lit("block")), F.lit(blocks)).cast("int"))


def small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MAX_BROADCAST_ROWS else df


def draw(scratch: Scratch, rows: DataFrame, weights, seed: int, shards: int, copies: int) -> tuple[DataFrame, int]:
    """``source, block, source_size, target, shard_list, part`` and the number of blocks: the shards that
    draw a copy of the block, and (else null) the words that the last copy is cut to."""
    spark = rows.sparkSession
    n = rows.count()
    blocks = max(BLOCKS, min(MAX_BLOCKS, 1 << (n // BLOCK_ROWS).bit_length()))
    sums = scratch.cut(blocked(rows, blocks).groupBy("source", "block").agg(F.sum("size").alias("words")), "blocks")
    per_source = sums.groupBy("source").agg(F.sum("words").alias("words"), F.count("*").alias("n"))
    held = per_source.orderBy(F.col("source").cast("binary").asc_nulls_last()).limit(MAX_SOURCES + 1).collect()
    if len(held) > MAX_SOURCES or len(held) * shards > MAX_LEAVES:
        raise ValueError(f"more than {MAX_SOURCES} sources, or {MAX_LEAVES} sources times shards")
    want = targets([r.words for r in held], [weights[i % len(weights)] for i in range(len(held))], copies)
    whole = [min(copies, int(t // r.words)) if r.words else 0 for t, r in zip(want, held)]
    extra = [max(0, round(t) - k * r.words) if r.words else 0 for t, k, r in zip(want, whole, held)]
    table = spark.createDataFrame(
        [(r.source, r.words, t, k, e, r.n) for r, t, k, e in zip(held, want, whole, extra)],
        "s string, source_size long, target double, whole int, extra long, n_blocks long",
    )
    # The blocks of a source in a seeded permutation: a row a block in a window.
    turn = Window.partitionBy("source").orderBy(F.xxhash64("source", "block", F.lit(seed)), "block")
    placed = scratch.cut(
        sums.join(small(table, len(held)), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        .withColumn("before", F.sum("words").over(turn) - F.col("words")).withColumn("turn", F.row_number().over(turn) - 1)
        .withColumn("left", F.greatest(F.lit(0), F.least(F.col("words"), F.col("extra") - F.col("before")))), "placed"
    )
    asked = {r.source: r.n for r in placed.groupBy("source").agg(F.sum(F.col("whole") + (F.col("before") < F.col("extra")).cast("int")).alias("n")).collect()}
    quotas = np.array([asked[r.source] for r in held], np.int64)
    ends = np.cumsum(deal(quotas, shards, np.random.default_rng(seed)), axis=0) if len(held) else np.zeros((shards, 0), np.int64)
    leaves = spark.createDataFrame([(r.source, ends[:, i].tolist()) for i, r in enumerate(held)], "s string, ends array<long>")
    # Copies of a block follow one another in passes; a copy goes to the leaf whose run holds its place.
    drawn = F.expr(f"filter(transform(sequence(0, {copies - 1}), p -> cast(aggregate(ends, 0, (n, e) -> n + if(e <= p * n_blocks + turn, 1, 0)) as int)), i -> i < {shards})")
    out = placed.join(small(leaves, len(held) * max(1, shards // 8)), F.col("source").eqNullSafe(F.col("s"))).withColumn("shard_list", drawn)
    part = F.when((F.col("left") > 0) & (F.col("left") < F.col("words")) & (F.size("shard_list") > F.col("whole")), F.col("left"))
    return scratch.cut(out.select("source", "block", "source_size", "target", "shard_list", part.alias("part")), "drawn"), blocks


def taken(rows: DataFrame, drawn: DataFrame, blocks: int, seed: int) -> DataFrame:
    """``rows`` with ``source_size, target, shard_list, taken`` and ``places``, the order of each copy in its shard."""
    names = rows.columns
    few = drawn.limit(MAX_BROADCAST_ROWS + 1).count()
    got = blocked(rows, blocks).alias("r").join(small(drawn, few).alias("d"), F.col("r.source").eqNullSafe(F.col("d.source")) & (F.col("r.block") == F.col("d.block")))
    got = got.select(*[F.col(f"r.{n}").alias(n) for n in names], "source_size", "target", "shard_list", "part")
    full = got.where("part IS NULL").withColumn("taken", F.col("size") * F.size("shard_list"))
    inside = Window.partitionBy("source").orderBy(F.xxhash64("id", "k", F.lit(seed)), "id", "k").rowsBetween(Window.unboundedPreceding, 0)
    more = F.greatest(F.lit(0), F.least(F.col("size"), F.col("part") - (F.sum("size").over(inside) - F.col("size"))))
    cut = got.where("part IS NOT NULL").withColumn("taken", F.col("size") * (F.size("shard_list") - 1) + more)
    cut = cut.withColumn("shard_list", F.expr("if(size = 0, shard_list, slice(shard_list, 1, cast(ceil(taken / size) as int)))"))
    out = full.unionByName(cut).withColumn("taken", F.col("taken").cast("long"))
    out = out.withColumn("shard_list", F.when(F.col("taken") > 0, F.col("shard_list")).otherwise(F.expr("cast(array() as array<int>)")))
    return out.withColumn("places", F.transform("shard_list", lambda s, i: F.xxhash64(F.col("id"), F.col("k"), i, F.lit(seed)))).drop("part")


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, seed: int = 7, shards: int = SHARDS, copies: int = MAX_COPIES) -> DataFrame:
    """``id_col, size, source_size, target, taken, shard_list, places`` for each document: a shard and a place in it for each copy."""
    scratch = Scratch(docs.sparkSession, "mix")
    rows = scratch.cut(measured(docs, id_col, text_col, source_col), "rows")
    out = taken(rows, *draw(scratch, rows, weights, seed, shards, copies), seed)
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", "taken", "shard_list", "places")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, seed: int = 7, shards: int = SHARDS, copies: int = MAX_COPIES) -> DataFrame:
    """The mixed rows of ``docs``, all columns: a row for each copy taken, the last one cut to the words taken.

    Rows are dealt to their shards (a large shard to several tasks, by the leading bits of the place)
    and sorted by shard and place. Texts are moved once.
    """
    names = docs.columns
    scratch = Scratch(docs.sparkSession, "mix")
    rows = scratch.cut(measured(docs, id_col, text_col, source_col), "rows")
    words = rows.agg(F.sum("size")).collect()[0][0] or 0
    drawn, blocks = draw(scratch, rows, weights, seed, shards, copies)
    got = taken(measured(docs, id_col, text_col, source_col, {c: f"c{i}" for i, c in enumerate(names)}), drawn, blocks, seed)
    got = got.select("*", F.posexplode("shard_list").alias("copy", "shard")).withColumn("place", F.expr("places[copy]"))
    parts = 1 << max(0, (int(words) // (WORDS_A_TASK * shards)).bit_length())
    lead = F.pmod(F.shiftrightunsigned("place", 40), F.lit(1 << 24)) * parts / (1 << 24)
    got = got.withColumn("lead", F.floor(lead)).withColumn("order", F.pmod(F.shiftrightunsigned("place", 40), F.lit(1 << 24)))
    got = got.repartition(shards * parts, "shard", "lead").sortWithinPartitions("shard", "order", "place", "copy")
    text, at = F.col(f"c{names.index(text_col)}"), F.col("taken") - F.col("copy") * F.col("size")
    piece = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0)), F.lit(1), at.cast("int")), "")
    return got.select(*[F.when(at < F.col("size"), piece).otherwise(text).alias(n) if n == text_col else F.col(f"c{i}").alias(n) for i, n in enumerate(names)])
