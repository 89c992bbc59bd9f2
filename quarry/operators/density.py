"""DBSCAN (CLU-03) and Euclidean silhouettes (CLU-06, CLU-10).

DBSCAN as a grid join. Equal points become one with a multiplicity. A fine grid (diagonal
below eps) finds dense cells: with ``min_samples`` rows in one, all its points are core and in
one cluster, and none of its pairs is looked at. The other points are loose: fewer than
``min_samples`` a fine cell, so in a bounded region they do not grow with the rows. They are
compared with all points around them: distinct points fall into cells of side eps on the
leading principal axes; a projection never lengthens a distance, so neighbours lie in adjacent
cells, and a loose point is sent only to those whose box it reaches. The axes come from a
bounded sample, cells from all points. Cells are cut into chunks, so a task holds two chunks
whatever the data; it returns counts, one row per point at most, never its pairs, and between
core points a spanning forest of the links it found.

Two dense cells are linked if their outermost points along a few directions are near. Pairs of
cells left in different clusters after that are compared point by point, only with the points
within eps of the other cell's box.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import md5key, q
from ..session import cut_lineage
from .graph import connected_components, join_groups, numbered
from .knn import point

AXES = 3  # principal axes that carry the grid
AXES_SAMPLE = 20_000  # points the axes are fitted on, at most
CHUNK = 2048  # points of a cell compared at once
SPARE = 1e-6  # the fine grid is smaller by this share, more than rounding moves a point
FINE_REACH = 1e9  # fine cells from the origin at which rounding stays below that
SILHOUETTE_ROWS = 10_000
SHOWN_VALUES = 200


def _axes(points: DataFrame, axes: int) -> np.ndarray:
    """Leading principal axes (dims x axes) of a seeded sample."""
    sample = points.orderBy(F.xxhash64("x"), "gid").limit(AXES_SAMPLE).select("x").collect()
    x = np.array([r["x"] for r in sample], float)
    _, _, v = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    return v[:axes].T


def _near(a: np.ndarray, b: np.ndarray, eps: float) -> np.ndarray:
    """Which rows of a and b are at most eps apart."""
    out = np.empty((len(a), len(b)), bool)
    step = max(1, 4_000_000 // max(b.size, 1))
    for i in range(0, len(a), step):
        out[i:i + step] = ((a[i:i + step, None, :] - b[None, :, :]) ** 2).sum(axis=2) <= eps * eps
    return out


def _located(points: DataFrame, eps: float) -> DataFrame:
    """``points`` with their place ``p`` on the leading axes, in units of eps, and its ``cell``."""
    shared = points.sparkSession.sparkContext.broadcast(_axes(points, AXES))
    names = [*points.columns, "p"]
    at = names.index("x")

    def project(batches):
        for batch in batches:
            x = batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            p = (x @ shared.value) / (eps * (1 + 1e-9))  # rounding never hides a neighbour
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p.tolist(), pa.list_(pa.float64()))], names=names)

    located = points.mapInArrow(project, T.StructType([*points.schema.fields, T.StructField("p", T.ArrayType(T.DoubleType()))]))
    return located.withColumn("cell", F.transform("p", lambda v: F.floor(v).cast("long")))


def _meetings(loose: DataFrame, others: DataFrame, width: int, chunk: int):
    """(cogroup of ``loose`` and ``others`` by task): every loose point meets every other point at
    most eps away in one task."""
    sizes = others.groupBy("cell").agg(F.ceil(F.count("*") / chunk).alias("their_parts"))
    offsets = F.array(*[F.array(*[F.lit(o).cast("long") for o in off]) for off in np.ndindex(*[3] * width)])
    beside = F.transform(offsets, lambda off: F.zip_with("cell", off, lambda c, o: c + o - 1))
    # how far the point lies from a neighbour's box, in cells, axis by axis
    gap = lambda n: F.aggregate(F.zip_with("p", n, lambda v, c: F.greatest(c - v, v - c - 1, F.lit(0.0))), F.lit(0.0), lambda s, g: s + g * g)
    sent = loose.withColumn("cell", F.explode(F.filter(beside, lambda n: gap(n) <= 1))).drop("p")
    parts = cut_lineage(sent.groupBy("cell").agg(F.ceil(F.count("*") / chunk).alias("parts")).join(sizes, "cell"))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("gid"), n)
    keep = ["cell", "gid", "x", "n", "rep", "core"]
    mine = sent.join(parts, "cell").select(*keep, own("parts").alias("a"), upto("their_parts").alias("b"))
    theirs = others.join(parts, "cell").select(*keep, own("their_parts").alias("b"), upto("parts").alias("a"))
    theirs = theirs.toDF(*theirs.columns)  # columns of its own, where both come from one table
    return mine.groupBy("cell", "a", "b").cogroup(theirs.groupBy("cell", "a", "b"))


def _pairs(mine: pa.Table, theirs: pa.Table, eps: float):
    """(gids of mine, gids of theirs, which are near): a point is not its own neighbour."""
    x, y = (np.array(t.column("x").to_pylist(), float) for t in (mine, theirs))
    a, b = mine.column("gid").to_numpy(), theirs.column("gid").to_numpy()
    if not len(a) or not len(b):
        return a, b, np.zeros((len(a), len(b)), bool)
    return a, b, _near(x, y, eps) & (a[:, None] != b[None, :])


def _counts(eps: float):
    """applyInArrow over one task: how many rows lie near each loose point."""
    def run(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        a, _, seen = _pairs(mine, theirs, eps)
        got = seen @ theirs.column("n").to_numpy()
        return pa.table({"gid": a[got > 0], "near": got[got > 0].astype(np.int64)})
    return run


def _forest(near: np.ndarray):
    """A spanning forest, (row, column) by (row, column), of the links between rows and columns."""
    rows, cols, out = np.ones(len(near), bool), np.ones(near.shape[1], bool), []
    for start in range(len(near)):
        todo = [start] if rows[start] else []
        rows[start] = False
        while todo:
            i = todo.pop()
            new = np.flatnonzero(near[i] & cols)
            if len(new):
                cols[new] = False
                out += [(i, j) for j in new]
                found = np.flatnonzero(near[:, new].any(axis=1) & rows)
                rows[found] = False
                out += zip(found, new[near[np.ix_(found, new)].argmax(axis=1)])
                todo += found.tolist()
    return np.array(out, np.int64).reshape(-1, 2)


def _links(eps: float):
    """applyInArrow over one task of loose and core points: (a, b, border): a spanning forest of
    the links between loose core points and others' representatives, and every representative
    (b) with a core point near a border point (a)."""
    def run(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        a, _, seen = _pairs(mine, theirs, eps)
        core = mine.column("core").to_numpy(zero_copy_only=False).astype(bool)
        reps, place = np.unique(theirs.column("rep").to_numpy(), return_inverse=True)
        near = np.zeros((len(a), len(reps)), bool)
        i, j = np.nonzero(seen)
        near[i, place[j]] = True
        inner, (at, to) = _forest(near[core]), np.nonzero(near & ~core[:, None])  # fewer than min_samples a border point
        return pa.table({"a": np.append(a[core][inner[:, 0]], a[at]), "b": np.append(reps[inner[:, 1]], reps[to]),
                         "border": np.append(np.zeros(len(inner), bool), np.ones(len(at), bool))})
    return run


def _dense_links(dense: DataFrame, links: DataFrame, width: int, axes: int, eps: float, chunk: int) -> DataFrame:
    """(a, b): links between representatives of dense cells that, with ``links``, join all
    dense cells of a cluster."""
    ways = [w for w in np.ndindex(*[3] * axes) if any(o != 1 for o in w)]
    along = lambda w: sum((F.col("p")[i] * (o - 1) for i, o in enumerate(w)), F.lit(0.0))
    least = lambda f, c, n: F.array(*[f(F.col(c)[i]) for i in range(n)])
    boxes = cut_lineage(dense.groupBy("rep").agg(least(F.min, "x", width).alias("lo"), least(F.max, "x", width).alias("hi"), least(F.min, "p", axes).alias("plo"),
                                                 least(F.max, "p", axes).alias("phi"), F.array(*[F.max_by("x", along(w)) for w in ways]).alias("outer")))

    def cells(reach):
        def run(batches):
            for pdf in batches:
                rows = [(r, list(c)) for r, lo, hi in zip(pdf["rep"], pdf["plo"], pdf["phi"])
                        for c in product(*[range(int(np.floor(u - reach)), int(np.floor(v + reach)) + 1) for u, v in zip(lo, hi)])]
                yield pd.DataFrame(rows, columns=["rep", "cell"])
        return boxes.select("rep", "plo", "phi").mapInPandas(run, "rep long, cell array<long>")

    met = cells(0).withColumnRenamed("rep", "a").join(cells(1).withColumnRenamed("rep", "b"), "cell").where("a <> b")
    met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = lambda e: boxes.select(F.col("rep").alias(e), *[F.col(c).alias(f"{c}_{e}") for c in ("lo", "hi", "outer")])

    def quick(batches):
        for pdf in batches:
            state = []
            for u, v, w, z, s, t in zip(*[pdf[c] for c in ("lo_a", "hi_a", "lo_b", "hi_b", "outer_a", "outer_b")]):
                apart = np.maximum(np.maximum(w - v, u - z), 0)
                if (apart ** 2).sum() > eps * eps * (1 + 1e-9):
                    state.append("apart")
                else:
                    state.append("near" if _near(np.array(s.tolist(), float), np.array(t.tolist(), float), eps).any() else "unsure")
            yield pdf[["a", "b"]].assign(state=state)

    tested = cut_lineage(met.join(side("a"), "a").join(side("b"), "b").mapInPandas(quick, "a long, b long, state string").where("state <> 'apart'"))
    sure = tested.where("state = 'near'").select("a", "b")
    roots = connected_components(links.union(sure))
    root = lambda e: roots.select(F.col("node").alias(e), F.col("root").alias(f"root_{e}"))
    unsure = tested.where("state = 'unsure'").join(root("a"), "a", "left").join(root("b"), "b", "left")
    unsure = cut_lineage(unsure.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b"))
    if unsure.isEmpty():
        return sure
    off = F.aggregate(F.zip_with(F.zip_with("x", "lo", lambda v, u: F.greatest(u - v, F.lit(0.0))), F.zip_with("x", "hi", lambda v, u: F.greatest(v - u, F.lit(0.0))), lambda g, h: g + h),
                      F.lit(0.0), lambda s, g: s + g * g)

    def end(e, o):
        """Points of the pair's cell ``e`` within eps of the other's box."""
        box = boxes.select(F.col("rep").alias(o), "lo", "hi")
        return dense.select(F.col("rep").alias(e), "gid", "x").join(unsure, e).join(box, o).where(off <= eps * eps * (1 + 1e-9)).select("a", "b", "gid", "x")

    one, two = end("a", "b"), end("b", "a")
    parts = one.groupBy("a", "b").agg(F.ceil(F.count("*") / chunk).alias("ps")).join(two.groupBy("a", "b").agg(F.ceil(F.count("*") / chunk).alias("qs")), ["a", "b"])
    parts = cut_lineage(parts)
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("gid"), n)
    one = one.join(parts, ["a", "b"]).select("a", "b", "gid", "x", own("ps").alias("p"), upto("qs").alias("q"))
    two = two.join(parts, ["a", "b"]).select("a", "b", "gid", "x", own("qs").alias("q"), upto("ps").alias("p"))

    two = two.toDF(*two.columns)

    def meet(key, mine: pa.Table, theirs: pa.Table) -> pa.Table:
        hit = [0] if _pairs(mine, theirs, eps)[2].any() else []
        return pa.table({"a": pa.array([key[0].as_py() for _ in hit], pa.int64()), "b": pa.array([key[1].as_py() for _ in hit], pa.int64())})

    at = ["a", "b", "p", "q"]
    return sure.union(one.groupBy(*at).cogroup(two.groupBy(*at)).applyInArrow(meet, "a long, b long").distinct())


def dbscan(df: DataFrame, key: str, features: list[str], eps: float = 0.5, min_samples: int = 5, chunk: int = CHUNK) -> DataFrame:
    """CLU-03: (key, cluster, kind) for every row of ``df``.

    A row is ``core`` if at least ``min_samples`` rows, itself included, lie within ``eps``; core
    rows within eps of each other share a cluster; a ``border`` row takes the smallest
    cluster among its core neighbours; the rest is ``noise``, cluster -1. Clusters are numbered
    from 0 in the order of their smallest core key. A row with a missing coordinate has null
    in both. Equal rows are each counted."""
    x = point(df, features)
    rows = cut_lineage(df.select(q(key).alias("key"), x.alias("x")))
    bad = F.coalesce(F.exists("x", lambda v: v.isNull() | F.isnan(v)), F.lit(True))
    gaps = rows.where(bad).select(q("key").alias(key), F.lit(None).cast("long").alias("cluster"), F.lit(None).cast("string").alias("kind"))
    whole = rows.where(~bad)
    points = cut_lineage(whole.groupBy("x").agg(F.count("*").alias("n"), F.min("key").alias("low")).withColumn("gid", F.monotonically_increasing_id()))
    some = points.select(F.size("x")).first()
    if some is None:
        return gaps
    width = some[0]
    axes = min(AXES, width)
    side = eps / width ** 0.5 * (1 - SPARE)
    fine = points.withColumn("fine", F.when(~F.exists("x", lambda v: F.abs(v / side) > FINE_REACH), F.transform("x", lambda v: F.floor(v / side).cast("long"))))
    crowds = fine.where("fine is not null").groupBy("fine").agg(F.sum("n").alias("rows"), F.min("gid").alias("rep")).where(F.col("rows") >= min_samples)
    points = fine.join(crowds, "fine", "left").select("gid", "x", "n", "low", F.coalesce("rep", "gid").alias("rep"), F.col("rep").isNotNull().alias("dense"))
    points = cut_lineage(_located(cut_lineage(points), eps))
    seen = _meetings(points.where("not dense").withColumn("core", F.lit(False)), points.withColumn("core", F.lit(False)), axes, chunk)
    seen = seen.applyInArrow(_counts(eps), "gid long, near long").groupBy("gid").agg(F.sum("near").alias("near"))
    known = cut_lineage(points.join(seen, "gid", "left").withColumn("core", F.col("dense") | (F.coalesce("near", F.lit(0)) + F.col("n") >= min_samples)).drop("near"))
    links = cut_lineage(_meetings(known.where("not dense"), known.where("core"), axes, chunk).applyInArrow(_links(eps), "a long, b long, border boolean"))
    joined = links.where("not border").select("a", "b")
    joined = cut_lineage(joined.union(_dense_links(known.where("dense"), joined, width, axes, eps, chunk)))
    roots = connected_components(joined)
    core = known.where("core").groupBy("rep").agg(F.min("low").alias("low")).join(roots, F.col("rep") == F.col("node"), "left").select("rep", "low", F.coalesce("root", "rep").alias("root"))
    clusters = numbered(core.groupBy("root").agg(F.min("low").alias("first")), ["first", "root"], "cluster").select("root", "cluster")
    core = cut_lineage(core.join(clusters, "root").select("rep", "cluster"))
    border = (links.where("border").join(core, F.col("b") == F.col("rep")).groupBy("a").agg(F.min("cluster").alias("beside"))
              .withColumnRenamed("a", "gid"))
    kind = F.when(F.col("core"), "core").when(F.col("beside").isNotNull(), "border").otherwise("noise")
    groups = known.join(core, "rep", "left").join(border, "gid", "left").select("x", "n", F.coalesce("cluster", "beside", F.lit(-1)).cast("long").alias("cluster"), kind.alias("kind"))
    out = join_groups(whole, cut_lineage(groups), "x", "n")
    return out.select(q("key").alias(key), "cluster", "kind").unionByName(gaps)


def silhouette_rows(assigned: DataFrame, key: str, features: list[str], col: str = "cluster", rows: int = SILHOUETTE_ROWS, seed: int = 42) -> DataFrame:
    """CLU-06: (key, cluster, silhouette) with Euclidean distances inside a seeded sample of at
    most ``rows`` rows, noise (-1) and rows without a cluster left out.

    s = (b - a) / max(a, b), a: mean distance to the rest of the own cluster, b: the smallest
    mean distance to another one; 0 for a cluster of one. Null where the sample has fewer than
    two clusters or one row each. The sample, ``rows`` points, is broadcast; each task adds
    its rows' distances up by cluster with one matrix product."""
    known = assigned.where(q(col).isNotNull() & (q(col) != -1)).select(q(key).alias("key"), q(col).alias("cluster"), point(assigned, features).alias("x"))
    known = known.where(F.coalesce(~F.exists("x", lambda v: v.isNull() | F.isnan(v)), F.lit(False)))
    sample = cut_lineage(known.withColumn("h", md5key(seed, F.col("key"))).orderBy("h", "key").limit(rows).drop("h").repartition(32, "key"))
    held = sample.select("cluster", "x").toPandas()  # bounded by ``rows``
    kind, size = sample.schema["key"].dataType.simpleString(), sample.schema["cluster"].dataType.simpleString()
    names, place = np.unique(held["cluster"].to_numpy(), return_inverse=True) if len(held) else (np.zeros(0), np.zeros(0, int))
    x = np.array(held["x"].tolist(), float) if len(held) else np.zeros((0, 1))
    shared = sample.sparkSession.sparkContext.broadcast((x, names, np.eye(len(names))[place] if len(names) else np.zeros((0, 0))))

    def score(batches):
        x, names, member = shared.value
        n = member.sum(axis=0)
        for pdf in batches:
            s = np.full(len(pdf), np.nan)
            if 2 <= len(names) < len(x):
                at, own = np.array(pdf["x"].tolist(), float), np.searchsorted(names, pdf["cluster"].to_numpy())
                sums = np.empty((len(at), len(names)))
                for i in range(0, len(at), 64):
                    sums[i:i + 64] = np.sqrt(((at[i:i + 64, None, :] - x[None, :, :]) ** 2).sum(axis=2)) @ member
                r = np.arange(len(at))
                a = sums[r, own] / np.maximum(n[own] - 1, 1)
                means = sums / n
                means[r, own] = np.inf
                b = means.min(axis=1)
                s = np.where(n[own] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0)
            yield pdf[["key", "cluster"]].assign(silhouette=s)

    out = sample.mapInPandas(score, f"key {kind}, cluster {size}, silhouette double")
    return out.select(q("key").alias(key), q("cluster").alias(col), F.when(~F.isnan("silhouette"), F.col("silhouette")).alias("silhouette"))


def silhouette_bars(scored: DataFrame, col: str = "cluster", shown: int = SHOWN_VALUES) -> DataFrame:
    """CLU-10: per cluster of ``silhouette_rows`` its size and up to ``shown`` of its values, evenly
    spaced in falling order: (cluster, size, place, value)."""
    from pyspark.sql import Window

    w = Window.partitionBy(col)  # the sample's rows at most
    ranked = scored.where("silhouette is not null").withColumn("size", F.count("*").over(w)).withColumn("place", F.row_number().over(w.orderBy(F.desc("silhouette"))) - 1)
    steps = F.least(F.col("size"), F.lit(shown)).cast("int")
    # the j-th of ``steps`` evenly spaced places is round(j * (size - 1) / (steps - 1))
    j = F.sequence(F.lit(0), steps - 1)
    wanted = F.transform(j, lambda k: F.bround(k * (F.col("size") - 1) / F.greatest(steps - 1, F.lit(1)), 0).cast("long"))
    return ranked.where(F.array_contains(wanted, F.col("place").cast("long"))).select(q(col), "size", F.col("place").cast("int").alias("place"), F.round("silhouette", 4).alias("value"))
