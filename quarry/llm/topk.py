"""Operator 8: exact top-k by distributed histogram selection.

Vectors become integers, scores are inner products. Queries are taken in blocks of
``QUERY_BLOCK`` (one block is broadcast: ``QUERY_BLOCK`` vectors whatever the corpus).
Per block, every task scores all its rows by a matrix product, and the k-th best score
of every query is located by global histograms that are refined ``BITS`` bits at a time:
a pass counts the scores in buckets inside the bucket found before, a grouped sum over
the tasks tells which bucket holds the k-th value. A task needs to report its buckets
only from the top down to its own k-th value, since the global k-th value is no less;
so a pass moves at most k + 1 rows a query and task. At width 1 the k-th value is known,
the last pass filters by it, and each task keeps its k best (score, then smaller id), of
which the k best overall are the answer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, use_small_batches

QUERY_BLOCK = 2048
BITS = 10  # refined in one pass
ROWS = 1024  # scored at once
SCALE = 256


def integer_vectors(table: DataFrame, vector: str = "embedding", key: str = "vec_id", scale: int = SCALE) -> DataFrame:
    """(uid, vec_id, v): floor(scale * x) of every usable row, numbered. Left out: null or empty
    vectors, vectors with null or non-finite components and null ids. Rows that share an id
    stay rows of their own."""
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | c.isin(float("inf"), float("-inf")))
    rows = (table.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("x"))
            .where("vec_id is not null and size(x) > 0").where(~bad))
    return rows.select(F.monotonically_increasing_id().alias("uid"), "vec_id", F.transform("x", lambda c: F.floor(c * scale).cast("double")).alias("v"))


def _rows(batches, width: int):
    """(row numbers, vec_ids, matrix) of ``ROWS`` rows at a time; vectors of another width than the queries' have no score."""
    for batch in batches:
        ids, vec, column = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2)
        fits = column.value_lengths().to_numpy(zero_copy_only=False) == width
        if not fits.all():
            ids, vec, column = ids[fits], vec[fits], column.filter(pa.array(fits))
        if len(ids):
            yield ids, vec, column.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), width)


def _scores(ids, matrix, query_ids, query_matrix, whole: bool):
    """Scores (queries x rows); a query's own row gets the lowest number there is."""
    if whole:
        s = (query_matrix @ matrix.T).astype(np.int64)  # exact: all sums stay below 2^53
    else:
        s = query_matrix.astype(np.int64) @ matrix.astype(np.int64).T
    place = np.searchsorted(query_ids, ids)
    own = np.flatnonzero((place < len(query_ids)) & (query_ids[np.minimum(place, len(query_ids) - 1)] == ids))
    s[place[own], own] = LOWEST
    return s


LOWEST = np.iinfo(np.int64).min


def _best(s: np.ndarray, k: int):
    """The k largest numbers of every row, unsorted."""
    return np.partition(s, s.shape[1] - k, axis=1)[:, -k:] if s.shape[1] > k else s


def _count(shared, k: int, shift: int):
    """mapInArrow: (query, bucket, n) of a task's scores inside the buckets found so far,
    from the top down to the task's own k-th (whose bucket is counted up to that one). Every
    score above the global k-th's bucket is among its task's k best, so what lies above it
    is counted whole."""
    def run(batches):
        query_ids, q, whole, known = shared.value["ids"], shared.value["matrix"], shared.value["whole"], shared.value["known"]
        top = None  # the bucket numbers of the task's k best scores of every query
        for ids, _, m in _rows(batches, q.shape[1]):
            s = _scores(ids, m, query_ids, q, whole)
            b = np.where(s == LOWEST, LOWEST, s >> shift)
            if known is not None:  # what lies above the bucket is counted there already; below it, nothing matters
                lo, step = known
                b = np.where((s >> (shift + step)) == lo[:, None], b, LOWEST)
                b[s == LOWEST] = LOWEST
            top = _best(b if top is None else np.concatenate([top, _best(b, k)], axis=1), k)
        if top is None:
            return
        who, _ = np.nonzero(top != LOWEST)
        values = top[top != LOWEST]
        if len(values):
            order = np.lexsort((values, who))
            who, values = who[order], values[order]
            cut = np.flatnonzero(np.concatenate([[True], (who[1:] != who[:-1]) | (values[1:] != values[:-1])]))
            n = np.diff(np.append(cut, len(who)))
            yield pa.RecordBatch.from_arrays([pa.array(query_ids[who[cut]]), pa.array(values[cut]), pa.array(n.astype(np.int64))], names=["query", "bucket", "n"])
    return run


def _take(shared, k: int):
    """mapInArrow: (query, vec_id, score) of a task's k best rows at or above the k-th value."""
    def run(batches):
        query_ids, q, whole, least = shared.value["ids"], shared.value["matrix"], shared.value["whole"], shared.value["least"]
        who = vec = score = np.zeros(0, np.int64)
        for ids, vecs, m in _rows(batches, q.shape[1]):
            s = _scores(ids, m, query_ids, q, whole)
            a, b = np.nonzero((s >= least[:, None]) & (s != LOWEST))
            who, vec, score = np.concatenate([who, a]), np.concatenate([vec, vecs[b]]), np.concatenate([score, s[a, b]])
            order = np.lexsort((vec, -score, who))
            who, vec, score = who[order], vec[order], score[order]
            first = np.concatenate([[0], np.flatnonzero(who[1:] != who[:-1]) + 1]) if len(who) else np.zeros(0, np.int64)
            rank = np.arange(len(who)) - np.repeat(first, np.diff(np.append(first, len(who))))
            who, vec, score = who[rank < k], vec[rank < k], score[rank < k]
        if len(who):
            yield pa.RecordBatch.from_arrays([pa.array(query_ids[who]), pa.array(vec), pa.array(score)], names=["query", "vec_id", "score"])
    return run


def _block(rows: DataFrame, queries: list, k: int) -> DataFrame:
    """The k best rows of each query of one block."""
    spark = rows.sparkSession
    queries.sort(key=lambda r: r["uid"])
    ids = np.array([r["uid"] for r in queries], np.int64)
    matrix = np.array([r["v"] for r in queries], np.float64)
    width = matrix.shape[1]
    high = rows.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0] or 0.0
    bound = int(width * np.abs(matrix).max(initial=0) * high)
    if bound >= 1 << 62:
        raise ValueError("inner products may leave 64 bits")
    whole = bound < 1 << 53
    bits = max(bound.bit_length() + 1, 1)
    # the k-th best value of each query: k best still to find, inside a known bucket
    wanted = np.full(len(ids), k, np.int64)
    known = None
    open_ = np.ones(len(ids), bool)
    shift = bits
    while shift > 0:
        step = min(BITS, shift)
        shift -= step
        shared = spark.sparkContext.broadcast({"ids": ids, "matrix": matrix, "whole": whole, "known": None if known is None else (known, step)})
        found = rows.mapInArrow(_count(shared, k, shift), "query long, bucket long, n long").groupBy("query", "bucket").agg(F.sum("n").alias("n"))
        over = Window.partitionBy("query").orderBy(F.desc("bucket"))
        # the highest buckets until the wanted count is reached: k + 1 rows a query at most
        told = (found.withColumn("above", F.sum("n").over(over) - F.col("n")).where(F.col("above") < k).collect())
        shared.unpersist()
        place = {q: i for i, q in enumerate(ids.tolist())}
        by_query: dict[int, list] = {}
        for r in told:
            by_query.setdefault(place[r["query"]], []).append((r["bucket"], r["n"], r["above"]))
        known_next = np.full(len(ids), LOWEST, np.int64)
        for i in range(len(ids)):
            if not open_[i]:
                continue
            for bucket, n, above in by_query.get(i, ()):
                if above < wanted[i] <= above + n:
                    known_next[i] = bucket
                    wanted[i] -= above
                    break
            else:  # fewer rows than k: all of them count
                open_[i] = False
        known = known_next
    least = np.where(open_, known, LOWEST)
    shared = spark.sparkContext.broadcast({"ids": ids, "matrix": matrix, "whole": whole, "least": least})
    names = spark.createDataFrame([(r["uid"], r["vec_id"]) for r in queries], "uid long, query_id long")  # one block
    found = rows.mapInArrow(_take(shared, k), "query long, vec_id long, score long")
    return found.join(F.broadcast(names), F.col("query") == F.col("uid")).select("query", "query_id", "vec_id", "score")


def top_k(table: DataFrame, is_query, k: int = 5, vector: str = "embedding", key: str = "vec_id", scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best rows other than itself.

    ``is_query`` is a condition on ``vec_id``. Rows that share a vec_id are queries each and
    candidates for each other. Higher scores first, ties to the smaller
    vec_id; all rows if there are fewer than k. See ``integer_vectors`` for the rows that
    take no part; vectors of another length than a query's have no score with it. Other
    columns are ignored, an empty table gives no rows. Raises ValueError where an inner
    product might not fit 64 bits.
    """
    use_small_batches(table.sparkSession, ROWS)
    rows = checkpointed(integer_vectors(table, vector, key, scale))
    asked = checkpointed(rows.where(is_query).select("uid", "vec_id", "v", F.size("v").alias("width")).repartitionByRange("width", "uid"))
    per = asked.groupBy("width").count().collect()  # one row per length of vector
    out = None
    for width, n in sorted((r["width"], r["count"]) for r in per):
        same = asked.where(F.col("width") == width)
        last = None
        for _ in range(-(-n // QUERY_BLOCK)):
            block = (same if last is None else same.where(F.col("uid") > last)).orderBy("uid").limit(QUERY_BLOCK).select("uid", "vec_id", "v").collect()
            last = block[-1]["uid"]
            part = checkpointed(_block(rows, block, k))
            out = part if out is None else out.union(part)
    if out is None:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
