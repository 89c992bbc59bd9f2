"""Structured Streaming replay (STR-01/02).

A fitted preprocessing state is column expressions only, so the same
``transform`` runs on a streaming DataFrame; a fitted spark.ml model scores a
stream with ``model.transform``. Sinks write to the shared checkpoint folder
with a checkpoint location, so a restarted query resumes exactly once.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from ..operators.prep import transform
from ..session import ensure_checkpoint_dir


def file_stream(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """One parquet table of a folder as a file stream."""
    return (spark.readStream.format("parquet").schema(schema)
            .option("pathGlobFilter", f"{name}.parquet").load(folder))


def replay_stream(state: dict, stream: DataFrame) -> DataFrame:
    """STR-01: the learned state replayed on a stream (stateless, append)."""
    return transform(state, stream)


def score_stream(model, stream: DataFrame) -> DataFrame:
    """STR-02: a fitted spark.ml PipelineModel scoring a stream."""
    return model.transform(stream)


def run_to_table(spark: SparkSession, stream: DataFrame, name: str, run_id: str) -> DataFrame:
    """Drain everything available (availableNow trigger) into a parquet table
    under spark.checkpoint.dir and return it as a batch DataFrame."""
    base = os.path.join(ensure_checkpoint_dir(spark), "quarry-stream", f"{name}-{run_id}")
    q = (stream.writeStream.format("parquet").option("path", os.path.join(base, "data"))
         .option("checkpointLocation", os.path.join(base, "chk")).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(os.path.join(base, "data"))
