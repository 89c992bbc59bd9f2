"""Operator 4: language identification by multinomial naive Bayes over hashed
character n-grams.

Fitting: each task adds the n-gram counts of its labelled texts into one vector per
language and sends it in blocks; blocks are summed in two levels (a salt bounds what
one group gathers), so all labelled rows count and nothing grows with the corpus but
the number of map tasks. Scoring: the log-probability matrix (languages x buckets,
bounded by ``MAX_LANGUAGES``) is broadcast, and a batch of texts is scored as one
sparse sum of its rows in numpy.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import use_small_batches

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
BLOCK = 1 << 13  # buckets summed as one row
SLICE = 1 << 18  # characters hashed at once
MAX_LANGUAGES = 256  # the matrix takes 256 KB a language; more labels than this are refused
SMOOTHING = 0.5

_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters (Unicode category L)."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def symbols(text: str | None) -> np.ndarray:
    """Lower-case code points, each run of other characters as one space, a space at
    either end; empty without a letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    alpha = letters()[codes]
    if not alpha.any():
        return np.zeros(0, np.uint32)
    codes = np.concatenate([[32], np.where(alpha, codes, 32), [32]]).astype(np.uint32)
    return codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])]


def ngrams(codes: np.ndarray):
    """Arrays of n-gram buckets, together all n-grams of the symbols."""
    for i in range(0, len(codes), SLICE):
        part = codes[i:i + SLICE + max(ORDERS) - 1].astype(np.uint64)
        h = np.zeros(len(part), np.uint64)
        for n in range(1, max(ORDERS) + 1):
            h = (h[:len(part) - n + 1] * np.uint64(0x100000001B3) + part[n - 1:]) * np.uint64(0x9E3779B97F4A7C15)
            if n in ORDERS:
                yield (h[:SLICE] >> np.uint64(48)).astype(np.int64)


def _add(tables) -> np.ndarray:
    return np.sum([np.frombuffer(t.as_py(), np.int64) for t in tables], axis=0)


def fit(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probability matrix (buckets x languages, float32) from
    ``labelled(lang, text)``; the last row holds the log priors. Null labels and texts
    without a letter teach nothing."""
    def count(batches):
        sums: dict[str, np.ndarray] = {}

        def flush():
            for lang, c in sums.items():
                for b in range(0, BUCKETS + 1, BLOCK):
                    if c[b:b + BLOCK].any():
                        yield lang, b, c[b:b + BLOCK].tobytes()
            sums.clear()

        def rows(found):
            x = list(zip(*found))
            return pa.RecordBatch.from_arrays([pa.array(x[0], pa.string()), pa.array(x[1], pa.int64()), pa.array(x[2], pa.binary())], names=["lang", "block", "counts"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                codes = symbols(text)
                if len(codes):
                    c = sums.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                    for ids in ngrams(codes):
                        c[:BUCKETS] += np.bincount(ids, minlength=BUCKETS)
                    c[BUCKETS] += 1
            if len(sums) > 64 and (found := list(flush())):
                yield rows(found)
        if found := list(flush()):
            yield rows(found)

    def total(key, part):
        return pa.table({"lang": [key[0].as_py()], "block": pa.array([key[1].as_py()], pa.int64()), "counts": [_add(part.column("counts")).tobytes()]})

    schema = "lang string, block long, counts binary"
    sent = (labelled.where("lang is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
            .mapInArrow(count, schema).withColumn("salt", F.spark_partition_id() % 64))
    once = sent.groupBy("lang", "block", "salt").applyInArrow(total, schema)
    blocks = once.groupBy("lang", "block").applyInArrow(total, schema).limit(MAX_LANGUAGES * (BUCKETS // BLOCK + 1) + 1).collect()
    languages = sorted({r["lang"] for r in blocks})
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} labels")
    counts = np.zeros((BUCKETS + 1, len(languages)))
    for r in blocks:
        c = np.frombuffer(r["counts"], np.int64)
        counts[r["block"]:r["block"] + len(c), languages.index(r["lang"])] = c
    if not languages:
        return [], np.zeros((BUCKETS + 1, 0), np.float32)
    body, prior = counts[:-1] + SMOOTHING, counts[-1] / counts[-1].sum()
    return languages, np.vstack([np.log(body / body.sum(axis=0)), np.log(prior)]).astype(np.float32)


def predictor(spark, languages: list[str], matrix: np.ndarray):
    """Column function: text -> struct(lang_pred, score)."""
    shared = spark.sparkContext.broadcast(matrix)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        table = shared.value
        sums = np.zeros((len(texts), len(languages)))
        seen = np.zeros(len(texts), bool)
        for i, text in enumerate(texts):
            codes = symbols(text)
            seen[i] = len(codes) > 0
            if seen[i] and languages:
                sums[i] = table[BUCKETS]
                for ids in ngrams(codes):
                    sums[i] += table[ids].sum(axis=0, dtype=np.float64) if len(ids) < BUCKETS else np.bincount(ids, minlength=BUCKETS) @ table[:BUCKETS]
        if not languages:
            return pd.DataFrame({"lang_pred": ["und"] * len(texts), "score": 0.0})
        best = sums.argmax(axis=1)
        share = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
        return pd.DataFrame({"lang_pred": [languages[b] if s else "und" for b, s in zip(best, seen)], "score": np.where(seen, share, 0.0)})

    return predict


def held_out():
    """Column: documents that are never learnt from (one in five by checksum of the id)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame):
    """Fit on the documents of ``docs`` that are not held out and have a label and an
    id; returns the column function of ``predictor``."""
    use_small_batches(docs.sparkSession)
    languages, matrix = fit(docs.where(F.col("doc_id").isNotNull() & ~held_out()).select("lang", "text"))
    return predictor(docs.sparkSession, languages, matrix)


def language_table(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): one row per row of ``docs``.

    The prediction reads the text alone. ``und`` (score 0) stands for null texts,
    texts without a letter and, where no labelled row exists, all texts; score is the
    posterior of the predicted language. Ties go to the language first in order. A row
    with a null doc_id is not held out and not learnt from. Repeated rows count as
    often as they occur. Other columns are ignored.
    """
    predict = identify(docs)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), predict(F.col("text").cast("string")).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")
