"""Shared helpers: staging tables in the cluster's shared folder, bounded broadcasts, connected components.

Conventions of the subpackage:

* A null text is an empty text. A repeated row is a row of its own.
* An operator reads the columns it is given by name and returns columns of its own, so extra
  columns of the input, whatever their names, never clash with them.
* Nothing here relies on local disks: lineage is cut by Parquet tables below
  ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import shutil
import tempfile
import uuid
import zipfile

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that separates words, as bytes and as a string.
WS_BYTES = b" \t\n\x0b\x0c\r"
WS = WS_BYTES.decode()

#: Ids up to this number (8 bytes each) are sent to every executor; beyond, a shuffle join is used.
MAX_BROADCAST_IDS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one, set for this session, only where it is unset."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        got = tempfile.mkdtemp(prefix="scholia-")
        atexit.register(shutil.rmtree, got, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", got)
    return got.rstrip("/")


class Scratch:
    """Tables of one operator call in the shared folder; ``drop`` removes those no longer read."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.base = spark, f"{shared_dir(spark)}/scholia-{tag}-{uuid.uuid4().hex}"

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back: short lineage, and a copy that outlives lost executors."""
        path = f"{self.base}/{name}"
        schema = df.schema
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs whose results have been written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def free_heaps(spark: SparkSession) -> None:
    """Let the executors' JVMs hand back heap that finished stages left, as Python workers share their memory limit.

    One empty task a core, each collecting garbage; an executor that gets none only keeps its heap.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()


def release() -> None:
    """Hand memory that a worker no longer needs back to the system, as workers live on after a task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def ship(spark: SparkSession, batch_bytes: int = 4 << 20) -> None:
    """Send this package to the executors, and bound Arrow batches by their bytes, whatever the texts' lengths."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(batch_bytes))
    sc = spark.sparkContext
    if getattr(sc, "_scholia_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    top = os.path.dirname(root)
    out = os.path.join(tempfile.mkdtemp(prefix="scholia-zip-"), "scholia_package.zip")
    atexit.register(shutil.rmtree, os.path.dirname(out), ignore_errors=True)
    with zipfile.ZipFile(out, "w") as z:
        for d, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(d, n), os.path.relpath(os.path.join(d, n), top))
    sc.addPyFile(out)
    sc._scholia_shipped = True


def restrict(docs: DataFrame, cols: str | list[str], ids: DataFrame, how: str = "left_semi", most: int = MAX_BROADCAST_IDS) -> DataFrame:
    """Rows of ``docs`` whose ``cols`` are (not) among the rows of ``ids``, whose columns stand in the same order.

    ``ids`` are counted first: up to ``most`` ids are broadcast, so that whole texts need not be
    shuffled; more are joined by a shuffle.
    """
    cols = [cols] if isinstance(cols, str) else cols
    ids = ids.select(*[F.col(c).alias(f"_scholia_id{i}") for i, c in enumerate(ids.columns)]).distinct()
    few = ids.limit(most + 1).count() <= most
    side = F.broadcast(ids) if few else ids.hint("merge")
    return docs.join(side, [docs[c] == side[f"_scholia_id{i}"] for i, c in enumerate(cols)], how)


def components(scratch: Scratch, links: DataFrame, name: str, max_rounds: int = 60) -> DataFrame:
    """``node, root`` for each node of ``links(a, b)``: root is the smallest node reachable.

    Smallest labels spread along links, then labels jump to their label's label, until nothing
    changes. Every step is a join and a partial aggregate, so a node with very many links is
    pre-aggregated on the map side and its rows are split by the adaptive skew join.
    """
    both = scratch.cut(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).where("a != b").distinct(), f"{name}-links")
    label = scratch.cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), f"{name}-0")
    for i in range(1, max_rounds + 1):
        near = (
            both.join(label.select(F.col("node").alias("b"), "root"), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("root").alias("low"))
        )
        hop = label.join(near, "node", "left").select("node", F.col("root").alias("was"), F.least("root", "low").alias("root"))
        jump = label.select(F.col("node").alias("root"), F.col("root").alias("far"))
        new = scratch.cut(hop.join(jump, "root", "left").select("node", "was", F.least("root", "far").alias("root")), f"{name}-{i}")
        changed = not new.where("root != was").limit(1).isEmpty()
        label = new.select("node", "root")
        scratch.drop(f"{name}-{i - 1}")
        if not changed:
            return label
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
