"""Helpers shared by the corpus operators: batches of text, shared folders and
connected components over a table of links."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Rows handed to a Python worker at once; texts may be long, so it is small.
BATCH_ROWS = 256


def use_small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lower the Arrow batch size so a worker never holds thousands of long texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) != rows:
        spark.conf.set(key, str(rows))


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: what follows
    survives lost executors without recomputing what went before."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared checkpoint folder."""
    base = spark.sparkContext.getCheckpointDir() or ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def text_bytes(column: str = "text"):
    """Length of a text in UTF-8 bytes, 0 for null."""
    return F.coalesce(F.octet_length(F.col(column)), F.lit(0)).cast("long")


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``links(a, b)`` (any orderable type).

    Returns (node, root): the smallest node reachable, for every node that has a
    link. Alternates the large-star and small-star steps of Kiveris et al. (2014):
    each round points neighbours at the smallest node seen and needs a number of
    rounds that grows with the logarithm of the longest path. Nothing but two
    numbers per round reaches the driver. A hub is the smaller end of its links
    after one round, so its rows are grouped with partial sums and joined with
    AQE's skew splitting, never gathered as a list.
    """
    edges = checkpointed(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = (both.join(low, both.a == low.k).where("b > a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
        pairs = large.join(low, large.a == low.k)
        small = (pairs.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                                                F.struct(F.col("a"), F.col("m").alias("b")))).alias("e"))
                 .select("e.a", "e.b").where("a <> b").distinct())
        edges = checkpointed(small)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def release_memory() -> None:
    """Gives memory freed by this Python worker back: workers wait for the next stage, beside a JVM
    that may need the room."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it keeps what it keeps
        pass


def local_path(uri: str) -> str:
    """The path of a ``file:`` URI or a plain path."""
    return uri[len("file://"):] if uri.startswith("file://") else uri[len("file:"):] if uri.startswith("file:") else uri


def open_store(uri: str):
    """(filesystem, path) of pyarrow for a shared folder: ``file:``, ``hdfs:``, ``s3:``..."""
    from pyarrow import fs

    if "://" in uri and not uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), os.path.abspath(local_path(uri))
