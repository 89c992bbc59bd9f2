"""Helpers on link tables: connected components, numbering in order, joins with hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

HOT_SHARE = 1000  # a key with more than 1/1000 of the rows is hot, so at most 1000 keys are


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links(a, b)``: the smallest node that it reaches.

    Large-star and small-star steps in turn (Kiveris et al., 2014): each round links the
    neighbours of a node to the smallest of them; the number of rounds grows with the
    logarithm of the longest path. Per round only a count and a checksum reach the driver."""
    edges = cut_lineage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.join(least, both.a == least.k).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
        met = large.join(least, large.a == least.k)
        ends = F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))
        edges = cut_lineage(met.select(F.explode(ends).alias("e")).select("e.a", "e.b").where("a <> b").distinct())
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen:
            roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
        seen = state
    raise RuntimeError("components did not settle")


def numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """``df`` with 0-based places in the order of the columns: range partitions are sorted
    apart, and a partition starts where the sizes of the earlier ones end."""
    parts = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order)
                        .withColumn("__pid", F.spark_partition_id()).withColumn("__mid", F.monotonically_increasing_id()))
    sizes = parts.groupBy("__pid").agg(F.count("*").alias("n"), F.min("__mid").alias("first"))  # one row per partition
    before = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("__pid")) - F.col("n")
    starts = sizes.select(F.col("__pid").alias("__p"), (before - F.col("first")).alias("__shift"))
    return parts.join(F.broadcast(starts), F.col("__pid") == F.col("__p")).withColumn(out, F.col("__mid") + F.col("__shift")).drop("__pid", "__mid", "__p", "__shift")


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """Inner join of ``rows`` with one row per value of ``key`` in ``groups``, where ``size`` is the
    number of rows of the value: hot values, at most ``HOT_SHARE``, are broadcast; no task meets
    all rows of one."""
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = F.col(size) * HOT_SHARE > F.lit(total)
    some, rest = F.broadcast(groups.where(hot)), groups.where(~hot)
    return rows.join(some, key).unionByName(rows.join(some, key, "left_anti").join(rest, key))
