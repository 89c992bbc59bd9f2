"""Parquet table source (SRC-04) and the NaN/inf cleanup applied on load (SRC-06)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


TEXT_TABLES = {"documents", "pages", "conversations"}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a scale-factor folder. Column pruning and filter
    pushdown reach the scan because nothing is read eagerly. Text tables that
    arrive in fewer splits than there are cores (one unsplittable row group)
    are spread round-robin so per-row text work runs in parallel; on a cluster
    with many files this is a no-op."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if name in TEXT_TABLES:
        df = widen(df)
    return df


def widen(df: DataFrame) -> DataFrame:
    """Repartition only when the input has fewer partitions than cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores * 2)
    return df


def register_tables(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Register every table as a temp view (for SQL-form operators)."""
    for n in names:
        read_table(spark, sf_dir, n).createOrReplaceTempView(n)


def _is_fractional(dt) -> bool:
    return isinstance(dt, (T.DoubleType, T.FloatType))


def inf_to_null(df: DataFrame) -> DataFrame:
    """SRC-06: NaN and +/-inf become NULL in floating columns so every later
    operator can rely on SQL null semantics (pandas treats NaN as missing)."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if _is_fractional(f.dataType):
            bad = F.isnan(c) | c.isin(float("inf"), float("-inf"))
            out.append(F.when(bad, F.lit(None).cast(f.dataType)).otherwise(c).alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def inf_report(df: DataFrame) -> DataFrame:
    """SRC-06 report: per floating column, how many values were NaN/inf.
    One aggregate pass, unpivoted to (column, n_inf)."""
    cols = [f.name for f in df.schema.fields if _is_fractional(f.dataType)]
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, n_inf long")
    aggs = [F.count_if(F.isnan(F.col(f"`{c}`")) | F.col(f"`{c}`").isin(float("inf"), float("-inf")))
            .alias(f"c{i}") for i, c in enumerate(cols)]
    wide = df.agg(*aggs)
    stack = ", ".join(f"'{c}', c{i}" for i, c in enumerate(cols))
    return wide.selectExpr(f"stack({len(cols)}, {stack}) as (column, n_inf)")
