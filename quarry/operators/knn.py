"""Exact k-nearest-neighbour join (JN-07) and k-distance (CLU-08).

No candidate cap:

1. identical reference coordinates collapse into one row with a multiplicity
   (a point repeated by a third of the rows is one row);
2. a k-d tree fitted on a bounded seeded sample of the distinct reference
   points cuts space into leaves of bounded expected size (the sample only
   places the cuts - every row is then routed by the broadcast tree); its
   subtrees of up to ``TILE_POINTS`` expected points are blocks;
3. round 1: each leaf answers its own queries, which gives every query an upper
   bound r of its k-th distance;
4. round 2: each query is sent to the blocks whose box comes within r (ball-box
   test against the broadcast boxes). Queries and points of a block meet in
   tiles of bounded size, whatever the block holds, so a task's memory is
   bounded and a block's work is spread;
5. the union is cut per query to the first groups whose multiplicities reach k.
Any true neighbour lies within r, hence in a routed block: the result is exact.

In few dimensions a query reaches a block or two. In many, boxes prune nothing and
the exact job is quadratic: a tile then finds its candidates by a matrix product
whose rounding error is bounded, and only these get their distance from the
coordinates' differences. A row is sent once a block, not once a leaf.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import md5key, q
from ..session import cut_lineage

SAMPLE = 20_000
MAX_SAMPLE = 200_000  # points the leaf boundaries are fitted on, at most
LEAF_ROWS = 4000
TILE_QUERIES = 32_768  # queries of a tile, as expected at most
TILE_POINTS = 65_536  # points of a tile, as expected at most
FIRST_ROUND = 8192  # queries and points of a leaf that meet for the first bound
STEP_QUERIES, STEP_POINTS = 1024, 4096  # compared by one matrix product
MAX_TASKS = 4000


def _build_tree(x: np.ndarray, leaf_size: int, block_size: int = 0):
    """Split at the median of the widest dimension; returns arrays
    (dim, thr, left, right, leaf_id), the block of every leaf and the block boxes (lo, hi).
    A block is a subtree of at most ``block_size`` points, or a leaf."""
    d = x.shape[1]
    dim, thr, left, right, leaf = [], [], [], [], []
    block, boxes_lo, boxes_hi = [], [], []

    def node(idx, lo, hi, inside):
        i = len(dim)
        dim.append(-1), thr.append(0.0), left.append(-1), right.append(-1), leaf.append(-1)
        sub = x[idx]
        span = sub.max(axis=0) - sub.min(axis=0) if len(idx) else np.zeros(d)
        last = len(idx) <= leaf_size or span.max() <= 0
        if not inside and (last or len(idx) <= block_size):
            boxes_lo.append(lo.copy()), boxes_hi.append(hi.copy())
            inside = True
        if last:
            leaf[i] = len(block)
            block.append(len(boxes_lo) - 1)
            return i
        j = int(np.argmax(span))
        t = float(np.median(sub[:, j]))
        m = sub[:, j] < t
        if m.all() or (~m).all():
            t = float((sub[:, j].min() + sub[:, j].max()) / 2)
            m = sub[:, j] < t
        dim[i], thr[i] = j, t
        lhi, rlo = hi.copy(), lo.copy()
        lhi[j], rlo[j] = t, t
        left[i] = node(idx[m], lo, lhi, inside)
        right[i] = node(idx[~m], rlo, hi, inside)
        return i
    node(np.arange(len(x)), np.full(d, -np.inf), np.full(d, np.inf), False)
    tree = {"dim": dim, "thr": thr, "left": left, "right": right, "leaf": leaf}
    return tree, np.array(block), np.array(boxes_lo), np.array(boxes_hi)


def _route(tree, x: np.ndarray) -> np.ndarray:
    dim, thr = np.asarray(tree["dim"]), np.asarray(tree["thr"])
    left, right, leaf = np.asarray(tree["left"]), np.asarray(tree["right"]), np.asarray(tree["leaf"])
    idx = np.zeros(len(x), dtype=np.int64)
    rows = np.arange(len(x))
    while True:
        inner = dim[idx] >= 0
        if not inner.any():
            break
        go = x[rows, np.where(inner, dim[idx], 0)] < thr[idx]
        idx = np.where(inner, np.where(go, left[idx], right[idx]), idx)
    return leaf[idx]


def point(df: DataFrame, features: list[str]):
    """The coordinates as one array column: of numeric columns, or a single array column itself."""
    if len(features) == 1 and isinstance(df.schema[features[0]].dataType, T.ArrayType):
        return q(features[0]).cast("array<double>")
    return F.array(*[q(f).cast("double") for f in features])


def _coords(pdf: pd.DataFrame) -> np.ndarray:
    return np.array(pdf["__x"].tolist(), dtype=float)


def _matrix(column) -> np.ndarray:
    """The coordinates of an Arrow list column."""
    column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 1))
    if pc.count_distinct(pc.list_value_length(column)).as_py() > 1:
        raise ValueError("points of different lengths")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _distances(qx, rx, i, j) -> np.ndarray:
    out = np.empty(len(i))
    for s in range(0, len(i), 65_536):
        out[s:s + 65_536] = np.sqrt(((qx[i[s:s + 65_536]] - rx[j[s:s + 65_536]]) ** 2).sum(axis=1))
    return out


def _closest(i, j, dist, rm, k, queries):
    """The rows (query, point, distance) up to the point whose multiplicities reach k, and that
    point's distance per query (inf: not reached)."""
    order = np.lexsort((j, dist, i))
    i, j, dist = i[order], j[order], dist[order]
    before = np.cumsum(rm[j]) - rm[j]
    first = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
    before = before - np.repeat(before[first], np.diff(np.append(first, len(i))))
    keep, kth = before < k, np.full(queries, np.inf)
    last = keep & (before + rm[j] >= k)
    kth[i[last]] = dist[last]
    return i[keep], j[keep], dist[keep], kth


def _nearest(qx, rx, rm, k, radius=None):
    """(query, point, distance, k-th distance per query): per query the nearest points, by
    distance, then place, until their multiplicities reach k; with ``radius``, none that is
    surely farther.

    Squared distances from a matrix product, wrong by ``slack`` at most, choose the candidates.
    Rows with non-finite coordinates are compared apart; such distances come last."""
    kth = np.full(len(qx), np.inf)
    none = np.zeros(0, np.int64)
    if not len(qx) or not len(rx):
        return none, none, np.zeros(0), kth
    bound = np.full(len(qx), np.inf) if radius is None else np.where(np.isnan(radius), np.inf, radius)
    fine, usual = np.isfinite(qx).all(axis=1), np.isfinite(rx).all(axis=1)
    places, odd = np.flatnonzero(usual), np.flatnonzero(~usual)
    b = rx[places]
    middle = b.mean(axis=0) if len(b) else np.zeros(rx.shape[1])
    b = b - middle
    bb = (b * b).sum(axis=1)
    most = np.sqrt(bb.max()) if len(b) else 0.0
    right = np.vstack([-2 * b.T, bb])
    out = []
    for s in range(0, len(qx), STEP_QUERIES):
        rows = np.arange(s, min(s + STEP_QUERIES, len(qx)))
        i, j, dist, got = none, none, np.zeros(0), np.full(len(rows), np.inf)

        def add(qi, ri):
            nonlocal i, j, dist, got
            far = _distances(qx[rows], rx, qi, ri)
            near = ~(far > bound[rows][qi] * (1 + 1e-9))
            if near.any():
                i, j, dist, got = _closest(np.append(i, qi[near]), np.append(j, ri[near]), np.append(dist, far[near]), rm, k, len(rows))

        good = np.flatnonzero(fine[rows])
        a = qx[rows[good]] - middle
        aa = (a * a).sum(axis=1)
        slack = 8 * (rx.shape[1] + 8) * np.finfo(float).eps * (np.sqrt(aa) + most) ** 2
        left = np.column_stack([a, np.ones(len(a))])
        reach = bound[rows[good]] ** 2 * (1 + 1e-9) - aa + slack
        for t in range(0, len(places) if len(good) else 0, STEP_POINTS):
            v = left @ right[:, t:t + STEP_POINTS]
            if not t and v.shape[1] > k:
                reach = np.minimum(reach, np.partition(v, k - 1, axis=1)[:, k - 1] + 2 * slack)
            hit = np.flatnonzero(~(v > reach[:, None]))
            if len(hit):
                add(good[hit // v.shape[1]], places[t + hit % v.shape[1]])
                reach = np.minimum(reach, got[good] ** 2 * (1 + 1e-9) - aa + slack)
        bad = np.flatnonzero(~fine[rows])
        short = good[np.isinf(got[good]) & np.isinf(bound[rows[good]])]
        for some, all_points in ((bad, np.arange(len(rx))), (short, odd)):
            for t in range(0, len(all_points) if len(some) else 0, STEP_POINTS):
                part = all_points[t:t + STEP_POINTS]
                add(np.repeat(some, len(part)), np.tile(part, len(some)))
        out.append((rows[i], j, dist))
        kth[rows] = got
    return *[np.concatenate(c) for c in zip(*out)], kth


def _by_key(points: pa.Table) -> pa.Table:
    """Equal distances go to the smaller key: points in its order."""
    return points.take(pc.sort_indices(points, sort_keys=[("__rk", "ascending")], null_placement="at_start"))


def _tile_parts(asked: DataFrame, known: DataFrame, at: str, queries: int, points: int) -> DataFrame:
    """(at, parts of its queries, parts of its points) per leaf or block with queries."""
    parts = lambda d, rows, name: d.groupBy(at).agg(F.ceil(F.count("*") / rows).alias(name))
    return parts(asked, queries, "__qs").join(parts(known, points, "__rs"), at, "left").fillna(1, ["__rs"])


def knn_join(left: DataFrame, lkey: str, right: DataFrame, rkey: str, features: list[str], k: int = 5,
             leaf_rows: int = LEAF_ROWS, seed: int = 42, carry: list[str] | tuple = (), tile: tuple[int, int] = (TILE_QUERIES, TILE_POINTS)) -> DataFrame:
    """(lkey, rkey, distance, multiplicity, rank[, carry...]): for each left
    row the nearest distinct right points (ties by key) until their
    multiplicities reach k. ``rkey`` is the smallest key among identical right
    points; ``carry`` columns of the right side (labels, values) are kept, so
    identical coordinates with different carried values stay apart."""
    carry = list(carry)
    spark = left.sparkSession
    x = point(left, features)  # one column, however many coordinates
    cs = [f"__c{i}" for i in range(len(carry))]
    whole = ~F.exists("__x", lambda v: v.isNull())
    groups = (right.select(q(rkey).alias("__rk"), x.alias("__x"), *[q(c).alias(n) for c, n in zip(carry, cs)])
              .where(whole).groupBy("__x", *cs).agg(F.min("__rk").alias("__rk"), F.count(F.lit(1)).alias("__m"))).transform(cut_lineage)
    n_groups = groups.count()
    wanted = min(MAX_SAMPLE, max(SAMPLE, 8 * n_groups // leaf_rows))  # several sampled points a leaf
    samp = groups.select("__x", md5key(seed, F.col("__rk")).alias("__h")).orderBy("__h").limit(wanted).select("__x").toArrow()
    samp = _matrix(samp.column("__x"))
    samp = samp[np.isfinite(samp).all(axis=1)]
    share = len(samp) / max(n_groups, 1)
    tree, block, lo, hi = _build_tree(samp, max(2 * k, int(share * leaf_rows)), int(share * tile[1]))
    bc = spark.sparkContext.broadcast((tree, block, lo, hi))
    rtype = right.schema[rkey].dataType.simpleString()
    ltype = left.schema[lkey].dataType.simpleString()

    def with_leaf(df, extra_schema):
        def f(batches):
            t, of, _, _ = bc.value
            for pdf in batches:
                leaf = _route(t, _coords(pdf)) if len(pdf) else np.array([], int)
                yield pdf.assign(__leaf=leaf, __block=of[leaf])
        return cut_lineage(df.mapInPandas(f, extra_schema + ", __leaf long, __block long"))

    gl = with_leaf(groups.select("__x", "__rk", "__m"), f"__x array<double>, __rk {rtype}, __m long")
    # equal queries are answered once, under the smallest of their keys
    asked = left.select(q(lkey).alias("__own"), x.alias("__x")).where(whole)
    ql = with_leaf(asked.groupBy("__x").agg(F.min("__own").alias("__lk")).select("__lk", "__x"), f"__lk {ltype}, __x array<double>")

    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)

    def bounded(asks: pa.Table, points: pa.Table) -> pa.Table:
        """Round 1: the k-th distance inside the leaf and the blocks within that."""
        at = _matrix(asks.column("__x"))
        r = _nearest(at, _matrix(points.column("__x")), points.column("__m").to_numpy(), k)[-1]
        _, _, blo, bhi = bc.value
        sent = []
        for i in range(0, len(at), 256):  # rows x blocks x coordinates at once
            part = at[i:i + 256]
            gap = np.maximum(np.maximum(blo[None, :, :] - part[:, None, :], part[:, None, :] - bhi[None, :, :]), 0)
            sent += [np.flatnonzero(row) for row in ~(np.sqrt((gap ** 2).sum(axis=2)) > r[i:i + 256, None] * (1 + 1e-9))]
        return pa.table({"__lk": asks.column("__lk"), "__x": asks.column("__x"), "__r": r, "__at": pa.array(sent, pa.list_(pa.int64()))})

    # any points of a leaf bound the k-th distance: hot leaves are cut, one part of their points is enough
    parts = F.broadcast(_tile_parts(ql, gl, "__leaf", FIRST_ROUND, FIRST_ROUND))  # a row a leaf, MAX_SAMPLE / 2 k at most
    mine = ql.join(parts, "__leaf").select("__lk", "__x", "__leaf", F.pmod(F.xxhash64("__x"), "__qs").alias("__q"))
    some = gl.join(parts, "__leaf").where(F.pmod(F.xxhash64("__x", "__rk"), "__rs") == 0).select("__x", "__rk", "__m", "__leaf", F.explode(upto("__qs")).alias("__q"))
    bounds = cut_lineage(mine.groupBy("__leaf", "__q").cogroup(some.groupBy("__leaf", "__q"))
                         .applyInArrow(bounded, f"__lk {ltype}, __x array<double>, __r double, __at array<long>"))

    def answered(asks: pa.Table, points: pa.Table) -> pa.Table:
        """Round 2: the candidates of one tile."""
        points = _by_key(points)
        rm = points.column("__m").to_numpy()
        i, j, dist, _ = _nearest(_matrix(asks.column("__x")), _matrix(points.column("__x")), rm, k, asks.column("__r").to_numpy())
        return pa.table({"__lk": asks.column("__lk").take(pa.array(i)), "__rk": points.column("__rk").take(pa.array(j)), "distance": dist, "multiplicity": rm[j]})

    routed = bounds.select("__lk", "__x", "__r", F.explode("__at").alias("__block"))
    sent = bounds.agg(F.sum(F.size("__at"))).first()[0] or 0
    queries = min(tile[0], max(STEP_QUERIES, sent // (3 * spark.sparkContext.defaultParallelism)))  # few rows: all cores
    parts = cut_lineage(_tile_parts(routed, gl, "__block", queries, tile[1]))  # a row a block
    tiles = parts.agg(F.sum(F.col("__qs") * F.col("__rs"))).first()[0] or 1
    parts = F.broadcast(parts)
    mine = routed.join(parts, "__block").select("__lk", "__x", "__r", "__block", F.pmod(F.xxhash64("__x"), "__qs").alias("__q"), F.explode(upto("__rs")).alias("__p"))
    theirs = gl.join(parts, "__block").select("__x", "__rk", "__m", "__block", F.pmod(F.xxhash64("__x", "__rk"), "__rs").alias("__p"), F.explode(upto("__qs")).alias("__q"))
    at, spread = ["__block", "__q", "__p"], min(2 * int(tiles), MAX_TASKS)  # tiles are few and heavy: not merged by size
    allc = cut_lineage(mine.repartition(spread, *at).groupBy(*at).cogroup(theirs.repartition(spread, *at).groupBy(*at))
                       .applyInArrow(answered, f"__lk {ltype}, __rk {rtype}, distance double, multiplicity long"))
    w2 = Window.partitionBy("__lk").orderBy("distance", "__rk")  # <= k rows a tile that the query is in
    cut = (allc.withColumn("rank", F.row_number().over(w2))
           .withColumn("__before", F.sum("multiplicity").over(w2.rowsBetween(Window.unboundedPreceding, -1)))
           .where(F.coalesce(F.col("__before"), F.lit(0)) < k))
    # back to every row that asked
    same = asked.join(ql.select(F.col("__x").alias("__y"), "__lk"), F.col("__x") == F.col("__y")).select("__own", "__lk")
    out = cut.join(same, "__lk").select(F.col("__own").alias(lkey), F.col("__rk").alias(rkey), "distance", "multiplicity",
                     F.col("rank").cast("int"), F.coalesce(F.col("__before"), F.lit(0)).alias("__before"))
    if carry:  # carried values back by the (unique) group key
        vals = groups.select(F.col("__rk").alias(rkey), *[F.col(n).alias(c) for c, n in zip(carry, cs)])
        out = out.join(vals, rkey)
    # multiplicity that counts toward the k neighbours (the last group may count in part)
    return out.withColumn("weight", F.least(F.col("multiplicity"), F.lit(k) - F.col("__before"))).drop("__before")


def k_distance(df: DataFrame, key: str, features: list[str], k: int = 4) -> DataFrame:
    """CLU-08: distance from every point to its k-th nearest other point
    (the point itself is one copy of its own coordinates)."""
    nn = knn_join(df.withColumnRenamed(key, "__q"), "__q", df.withColumnRenamed(key, "__r0"), "__r0", features, k + 1)
    w = Window.partitionBy("__q").orderBy("distance", "__r0")
    c = nn.withColumn("__cum", F.sum("multiplicity").over(w) - 1)  # one copy is the point itself
    return (c.where(F.col("__cum") >= k).groupBy("__q").agg(F.min("distance").alias("k_distance"))
            .withColumnRenamed("__q", key))


def knn_predict(train: DataFrame, test: DataFrame, features: list[str], label: str, train_key: str,
                test_key: str, k: int = 5, task: str = "classification") -> DataFrame:
    """MDL-04: uniform k-nearest-neighbour vote (ties to the smallest class)
    or mean (regression) over exactly k training rows."""
    nn = knn_join(test, test_key, train.withColumnRenamed(train_key, "__tk"), "__tk", features, k, carry=[label])
    if task == "classification":
        v = nn.groupBy(test_key, label).agg(F.sum("weight").alias("votes"))
        w = Window.partitionBy(test_key).orderBy(F.desc("votes"), F.asc(label))  # <= k rows per key
        return (v.withColumn("__r", F.row_number().over(w)).where(F.col("__r") == 1)
                .select(test_key, F.col(label).alias("prediction"), "votes"))
    return nn.groupBy(test_key).agg((F.sum(F.col("weight") * F.col(label)) / F.sum("weight")).alias("prediction"))


def knn_impute(train: DataFrame, df: DataFrame, features: list[str], column: str, key: str, k: int = 5) -> DataFrame:
    """PRE-01 (re-aimed to complete feature coordinates): a missing ``column``
    becomes the mean over the k nearest TRAIN rows that have it; rows with a
    missing coordinate get the train mean."""
    ref = train.where(q(column).isNotNull()).select(q(key).alias("__tk"), *[q(f) for f in features], q(column))
    mean = ref.agg(F.avg(q(column))).first()[0]
    todo = df.where(q(column).isNull())
    complete = todo.dropna(subset=features)
    nn = knn_join(complete, key, ref, "__tk", features, k, carry=[column])
    fill = nn.groupBy(key).agg((F.sum(F.col("weight") * q(column)) / F.sum("weight")).alias("__fill"))
    out = df.join(fill, key, "left")
    return out.withColumn(column, F.coalesce(q(column), F.col("__fill"), F.lit(mean))).drop("__fill")


def knn_impute_block(train: DataFrame, df: DataFrame, columns: list[str], key: str, k: int = 5) -> DataFrame:
    """PRE-01: every missing value of the numeric block ``columns`` becomes the mean over the k
    nearest rows of ``train`` that have it, by nan-Euclidean distance: over the coordinates
    that both rows have, squared sum times (columns / coordinates). Ties go to the smaller key.
    A value without such a row (no coordinate in common, or nobody has it) becomes the train
    mean, null if there is none.

    Rows are grouped by the pattern of their gaps, as are training rows. Between two patterns the
    distance is a plain Euclidean one over fixed coordinates, so one exact kNN join answers all
    their values at once; a value's answers from the patterns are cut to the k nearest."""
    from .models import FITS_AT_ONCE

    bits = lambda d: sum((F.when(F.isnan(q(c).cast("double")) | q(c).isNull(), 0).otherwise(1 << i) for i, c in enumerate(columns)), F.lit(0))
    known = cut_lineage(train.select(q(key).alias("__tk"), *[F.nanvl(q(c).cast("double"), F.lit(None)).alias(f"__v{i}") for i, c in enumerate(columns)], bits(train).alias("__has")))
    asked = cut_lineage(df.select(q(key).alias("__q"), *[F.nanvl(q(c).cast("double"), F.lit(None)).alias(f"__v{i}") for i, c in enumerate(columns)], bits(df).alias("__has")))
    patterns = lambda d: sorted(r[0] for r in d.select("__has").distinct().collect())  # noqa: E731 - at most one per combination of gaps
    full = (1 << len(columns)) - 1
    donors = patterns(known)
    pairs = [(p, m) for p in patterns(asked) if p != full for m in donors if p & m and m & ~p]

    def near(pair):
        p, m = pair
        both = [i for i in range(len(columns)) if (p & m) >> i & 1]
        wanted = [i for i in range(len(columns)) if m >> i & 1 and not p >> i & 1]
        nn = knn_join(asked.where(F.col("__has") == p), "__q", known.where(F.col("__has") == m), "__tk", [f"__v{i}" for i in both], k, carry=[f"__v{i}" for i in wanted])
        far = F.col("distance") * (len(columns) / len(both)) ** 0.5
        value = F.explode(F.array(*[F.struct(F.lit(i).alias("column"), F.col(f"__v{i}").alias("value")) for i in wanted])).alias("c")
        return cut_lineage(nn.select("__q", "__tk", far.alias("distance"), "multiplicity", value).select("__q", "__tk", "distance", "multiplicity", "c.column", "c.value"))

    with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
        found = list(pool.map(near, pairs))
    means = known.agg(*[F.avg(f"__v{i}").alias(f"m{i}") for i in range(len(columns))]).first()
    out = df
    if found:
        answers = found[0]
        for f in found[1:]:
            answers = answers.unionByName(f)
        w = Window.partitionBy("__q", "column").orderBy("distance", "__tk")  # k rows a pattern
        answers = answers.withColumn("before", F.sum("multiplicity").over(w) - F.col("multiplicity")).where(F.col("before") < k)
        share = F.least(F.col("multiplicity"), k - F.col("before"))
        fill = answers.groupBy("__q").agg(*[(F.sum(F.when(F.col("column") == i, share * F.col("value"))) / F.sum(F.when(F.col("column") == i, share))).alias(f"__f{i}") for i in range(len(columns))])
        out = df.join(fill, q(key) == F.col("__q"), "left")
    filled = {c: F.coalesce(F.nanvl(q(c).cast("double"), F.lit(None)), *([F.col(f"__f{i}")] if found else []), F.lit(means[f"m{i}"]).cast("double")) for i, c in enumerate(columns)}
    return out.select(*[filled[c].alias(c) if c in filled else q(c) for c in df.columns])


def smote(df: DataFrame, features: list[str], label: str, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """PRE-11: synthetic minority rows x + u (neighbour - x) inside each
    minority class until it matches the largest class; neighbour and u come
    from md5 keys (deterministic). Returns the original rows plus the new ones."""
    from ..functions.columns import uniform
    counts = {r[0]: int(r[1]) for r in df.groupBy(q(label).cast("string")).count().collect()}
    top = max(counts.values())
    v = point(df, features)
    whole = df.select(q(key).alias("__q"), v.alias("__v"), q(label).cast("string").alias("__l")).persist()
    names = features if len(features) == 1 and isinstance(df.schema[features[0]].dataType, T.ArrayType) else None

    def back(key_col, vec, lab):
        """The output columns: the array itself, or its coordinates."""
        cols = [vec.alias(names[0])] if names else [vec[i].alias(f) for i, f in enumerate(features)]
        return [key_col.cast("string").alias(key), *cols, lab.alias(label)]

    parts = [whole.select(*back(F.col("__q"), F.col("__v"), F.col("__l")))]
    for cls, n in counts.items():
        need = top - n
        if need <= 0 or n < 2:
            continue
        members = whole.where(F.col("__l") == cls).select("__q", "__v")
        kk = min(k, n - 1)
        nn = knn_join(members, "__q", members.withColumnRenamed("__q", "__n"), "__n", ["__v"], kk + 1)
        nn = nn.where(F.col("__q") != F.col("__n"))
        w = Window.partitionBy("__q")  # <= k + 1 rows per point; equal points count as one neighbour
        nn = nn.withColumn("__j", F.row_number().over(w.orderBy("distance", "__n")) - 1).withColumn("__of", F.count("*").over(w))
        per, extra = divmod(need, n)
        base = members
        from .prep import class_ranks
        ranked = base.join(class_ranks(base.select("__q"), "__q", seed).select("__q", "__rank"), "__q").withColumn(
            "__copies", F.lit(per) + F.when(F.col("__rank") <= extra, 1).otherwise(0)).where(F.col("__copies") > 0)
        copies = ranked.select("*", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))).alias("__c"))
        copies = copies.withColumn("__h", (F.conv(F.substring(F.md5(F.concat_ws(
            "|", F.lit(str(seed)), F.col("__q").cast("string"), F.col("__c").cast("string"))), 1, 8), 16, 10)
            .cast("long"))).withColumn("__u", uniform(seed + 1, F.col("__q"), F.col("__c")))
        # a point whose neighbours all equal it has none here and is its own neighbour
        known = nn.select(F.col("__q").alias("__p"), "__j", "__n", "__of")
        alone = members.select(F.col("__q").alias("__p")).join(known.select("__p").distinct(), "__p", "left_anti")
        near = known.unionByName(alone.select("__p", F.lit(0).alias("__j"), F.col("__p").alias("__n"), F.lit(1).cast("long").alias("__of")))
        pick = copies.join(near, (F.col("__q") == F.col("__p")) & (F.pmod(F.col("__h"), F.col("__of")) == F.col("__j"))).drop("__p")
        nb = members.select(F.col("__q").alias("__n"), F.col("__v").alias("__w"))
        made = F.zip_with("__v", "__w", lambda a, b: a + F.col("__u") * (b - a))
        name = F.concat(F.lit("smote-"), F.col("__q").cast("string"), F.lit("-"), F.col("__c").cast("string"))
        syn = pick.join(nb, "__n").withColumn("__made", made).select(*back(name, F.col("__made"), F.lit(cls)))
        parts.append(syn)
    out = parts[0]
    for p_ in parts[1:]:
        out = out.unionByName(p_)
    return out
