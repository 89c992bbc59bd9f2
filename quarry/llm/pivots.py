"""Operator 7: near-duplicate vectors by a pivot-permutation index.

Every vector is described by the ordered list of its ``PREFIX`` nearest reference points
(pivots), by cosine. Pivots are fitted on a bounded sample (``2 sqrt(n)`` vectors, at most
``MAX_PIVOTS``, thinned so that no two are close: a crowd of near copies in the sample
would otherwise fill the lists of its neighbourhood with interchangeable pivots). All
vectors are indexed: they enter the inverted lists of their pivots within their label.
Candidates share at least ``SHARED`` pivots. Of two such vectors the first PREFIX - SHARED + 1
pivots by number have one in common, so only those lists are kept, and a pair is looked
at in one list alone, that of its first common pivot. Candidates are then verified by
their cosine in double precision.

Equal vectors are one row with a count, so exact copies never meet each other. A list
with more than ``CHUNK`` vectors is cut into chunk pairs that are compared in tasks of
their own; a cell reports link counts per vector and a spanning forest, never its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, components, use_small_batches

PREFIX = 10
SHARED = 5
MAX_PIVOTS = 8192
CHUNK = 2048
APART = 0.9  # pivots are less alike than this
ROWS = 4096  # vectors described at once


def unit(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 (first by their largest component, against overflow)."""
    m = matrix.astype(np.float64)
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def spread(sample: np.ndarray, most: int) -> np.ndarray:
    """The first rows of a sample of unit vectors that are not close to an earlier one."""
    chosen = np.zeros((0, sample.shape[1]))
    for i in range(0, len(sample), 256):
        part = sample[i:i + 256]
        part = part[(part @ chosen.T < APART).all(axis=1)]
        near = part @ part.T >= APART
        keep = np.zeros(len(part), bool)
        for j in range(len(part)):
            keep[j] = not (near[j, :j] & keep[:j]).any()
        chosen = np.concatenate([chosen, part[keep]])
        if len(chosen) >= most:
            break
    return chosen[:most]


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _describe(shared, prefix: int):
    """mapInArrow over (gid, x) of one width: the numbers of the nearest pivots, ascending."""
    def run(batches):
        pivots = shared.value
        for batch in batches:
            if batch.num_rows:
                like = unit(_matrix(batch.column(1))) @ pivots.T
                m = min(prefix, like.shape[1])
                near = np.sort(np.argpartition(-like, m - 1, axis=1)[:, :m], axis=1).astype(np.int32)
                lists = pa.ListArray.from_arrays(np.arange(0, near.size + 1, m, dtype=np.int32), pa.array(near.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["gid", "near"])
    return run


def _compare(threshold: float, shared: int):
    """Cell of a list: link counts (gid, null, n) and a spanning forest (gid, other, 0)."""
    def run(key, rows):
        order = np.argsort(rows.column("gid").to_numpy())
        gid, n = rows.column("gid").to_numpy()[order], rows.column("n").to_numpy()[order]
        part = rows.column("part").to_numpy()[order]
        pivot = key[2].as_py()
        x, near = unit(_matrix(rows.column("x")))[order], _matrix(rows.column("near"))[order]
        names, place = np.unique(near, return_inverse=True)
        # 1 for each pivot in common, 4096 more for each that comes before this list's
        sets = np.zeros((len(gid), len(names)), np.float32)
        np.put_along_axis(sets, place.reshape(near.shape), np.where(near < pivot, 64, 1).astype(np.float32), axis=1)
        first = part == part.min()
        two = not first.all()
        left = np.flatnonzero(first) if two else np.arange(len(gid))
        right = np.flatnonzero(~first) if two else left
        linked = np.zeros((len(left), len(right)), bool)
        for i in range(0, len(left), 512):
            rows_ = left[i:i + 512]
            common = sets[rows_] @ sets[right].T
            candidate = (common >= shared) & (common < 4096)
            linked[i:i + 512] = candidate & (x[rows_] @ x[right].T >= threshold)
        if not two:
            np.fill_diagonal(linked, False)
        add = np.zeros(len(gid), np.int64)
        add[left] += linked @ n[right]
        if two:
            add[right] += linked.T @ n[left]
        a, b = _forest(linked, two)
        has = np.flatnonzero(add)
        a, b = gid[left[a]], gid[right[b]]
        return pa.table({"gid": np.concatenate([gid[has], a]), "other": pa.array(np.concatenate([np.zeros(len(has), np.int64), b]), mask=np.arange(len(has) + len(b)) < len(has)),
                         "n": np.concatenate([add[has], np.zeros(len(a), np.int64)])})
    return run


def _forest(linked: np.ndarray, two: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) links that connect what the matrix connects. With ``two`` rows and
    columns are different vectors, else the same ones."""
    todo_rows = linked.any(axis=1)
    free = linked.any(axis=0)  # columns not reached yet
    a, b = [], []
    while todo_rows.any():
        start = int(np.argmax(todo_rows))
        stack = [start]
        todo_rows[start] = False
        if not two:
            free[start] = False
        while stack:
            r = stack.pop()
            hit = np.flatnonzero(linked[r] & free)
            free[hit] = False
            a += [r] * len(hit)
            b += hit.tolist()
            if not two:
                todo_rows[hit] = False
                stack += hit.tolist()
            else:
                for c in hit.tolist():
                    more = np.flatnonzero(linked[:, c] & todo_rows)
                    todo_rows[more] = False
                    a += more.tolist()
                    b += [c] * len(more)
                    stack += more.tolist()
    return np.array(a, np.int64), np.array(b, np.int64)


SALTS = 64  # places for the vectors of one component


def near_vectors(table: DataFrame, threshold: float = 0.98, prefix: int = PREFIX, shared: int = SHARED, max_pivots: int = MAX_PIVOTS,
                 chunk: int = CHUNK, vector: str = "embedding", label: str = "label", key: str = "vec_id") -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per row of ``table``.

    Vectors are compared where labels are equal, not null, and lengths agree. Vectors that
    are null, empty or zero or hold null or non-finite components link with nothing. A
    repeated row is another vector with the same id. A null vec_id keeps its row;
    component_id ignores null ids and is null if the component has no other. Pairs found
    have a cosine of at least ``threshold``; a pair that shares fewer than ``shared`` of its
    ``prefix`` nearest pivots is missed (README has the recall). Other columns are ignored.
    """
    spark = table.sparkSession
    use_small_batches(spark, ROWS)
    rows = table.select(F.col(key).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("x"))
    wide = F.col("x").cast("array<double>")
    odd = F.exists(wide, lambda c: c.isNull() | F.isnan(c) | c.isin(float("inf"), float("-inf")))
    usable = rows.where(F.col("label").isNotNull() & (F.size("x") > 0)).where(~odd).where(F.exists("x", lambda c: c != 0))
    distinct = checkpointed(usable.groupBy("label", "x").agg(F.count("*").alias("n"), F.min("vec_id").alias("low")).withColumn("gid", F.monotonically_increasing_id()))
    found = None
    for width, total in sorted((r["w"], r["count"]) for r in distinct.groupBy(F.size("x").alias("w")).count().collect()):
        same = distinct.where(F.size("x") == width)
        most = min(max_pivots, max(64, int(2 * total ** 0.5)))
        sample = same.orderBy(F.xxhash64("x"), "gid").limit(4 * most).select("x").collect()
        pivots = spark.sparkContext.broadcast(spread(unit(np.array([r["x"] for r in sample])), most))
        part = _links(same, pivots, threshold, min(prefix, len(pivots.value)), min(shared, len(pivots.value)), chunk)
        found = part if found is None else found.union(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = checkpointed(found)
    roots = components(found.where("other is not null").select(F.col("gid").alias("a"), F.col("other").alias("b")))
    links = found.where("other is null").groupBy("gid").agg(F.sum("n").alias("links"))
    named = (distinct.join(links.withColumnRenamed("gid", "g1"), F.col("gid") == F.col("g1"), "left").join(roots, F.col("gid") == F.col("node"), "left")
             .select("label", "x", "low", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "gid", F.coalesce("root", "gid").alias("root")))
    # a component may hold very many vectors: its answer goes to SALTS places
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("size"))
    alone, lows = lows.where("size = 1"), lows.where("size > 1").withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    lows = alone.withColumn("place", F.pmod(F.xxhash64("root"), F.lit(SALTS)).cast("int")).union(lows)
    # a vector on its own is its own root, so its place is known
    named = named.withColumn("place", F.pmod(F.when(F.col("root") == F.col("gid"), F.xxhash64("root")).otherwise(F.xxhash64("gid")), F.lit(SALTS)).cast("int"))
    known = named.drop("low").join(lows, ["root", "place"]).select(F.col("label").alias("l"), F.col("x").alias("y"), "n_links", "component_id", F.lit(True).alias("known"))
    out = rows.join(known, (F.col("label") == F.col("l")) & (F.col("x") == F.col("y")), "left")
    component = F.when(F.col("known"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def _links(same: DataFrame, pivots, threshold: float, prefix: int, shared: int, chunk: int) -> DataFrame:
    """Link counts and forest (gid, other, n) among distinct vectors of one length."""
    near = same.select("gid", "x").mapInArrow(_describe(pivots, prefix), "gid long, near array<int>").withColumnRenamed("gid", "g")
    sent = (same.join(near, F.col("gid") == F.col("g")).select("gid", "label", "x", "n", "near", F.explode(F.slice("near", 1, prefix - shared + 1)).alias("pivot")))
    sizes = sent.groupBy("label", "pivot").agg(F.count("*").alias("size")).where("size > 1").select(F.col("label").alias("l"), F.col("pivot").alias("p"), "size")
    parts = F.ceil(F.col("size") / chunk).cast("long")
    own = F.pmod(F.xxhash64("gid"), parts)
    cells = F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda j: F.least(own, j) * parts + F.greatest(own, j))
    dealt = (sent.join(sizes, (F.col("label") == F.col("l")) & (F.col("pivot") == F.col("p")))
             .select("label", F.explode(F.when(parts == 1, F.array(F.lit(0).cast("long"))).otherwise(cells)).alias("cell"), "pivot", "gid", "x", "n", "near", own.alias("part")))
    return dealt.groupBy("label", "cell", "pivot").applyInArrow(_compare(threshold, shared), "gid long, other long, n long")
