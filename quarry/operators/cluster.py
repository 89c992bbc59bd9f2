"""Clustering (CLU-01..11) on spark.ml plus distributed quality measures.

K-Means / bisecting K-Means / Gaussian mixture are spark.ml. Davies-Bouldin
and Calinski-Harabasz come from per-cluster aggregates (centroids, scatter);
the silhouette is spark.ml's (squared Euclidean, all rows) here and exact on a seeded
sample in ``density``. Coordinates are one array column, however many there are.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import q
from ..session import cut_lineage
from .knn import point
from .models import FITS_AT_ONCE


def _vec(df: DataFrame, features: list[str]) -> DataFrame:
    """``df`` with its coordinates as the vector ``features``; null where one is missing."""
    x = point(df, features)
    gap = F.coalesce(F.exists(x, lambda v: v.isNull() | F.isnan(v)), F.lit(True))
    return df.withColumn("features", F.when(~gap, array_to_vector(x)))


def fit_clusters(df: DataFrame, features: list[str], method: str = "kmeans", k: int = 3, seed: int = 42):
    """CLU-01/02/04: returns (model, ``df`` with ``cluster`` and the vector ``features``). Fitted on the
    complete rows; a row with a missing coordinate keeps its place with a null cluster. The
    result is materialised once, so scores on it fit nothing again."""
    d = cut_lineage(_vec(df, features))
    whole = d.where(F.col("features").isNotNull())
    est = {"kmeans": KMeans(k=k, seed=seed), "bisecting": BisectingKMeans(k=k, seed=seed),
           "gmm": GaussianMixture(k=k, seed=seed)}[method]
    model = est.fit(whole)
    out = model.transform(whole).withColumnRenamed("prediction", "cluster").drop("probability")
    rest = d.where(F.col("features").isNull()).withColumn("cluster", F.lit(None).cast("int"))
    return model, cut_lineage(out.unionByName(rest))


def cluster_sizes(assigned: DataFrame, col: str = "cluster") -> DataFrame:
    """CLU-09: size per cluster (-1 = noise counted separately)."""
    return assigned.groupBy(col).agg(F.count(F.lit(1)).alias("size"))


def centroid_scores(assigned: DataFrame, features: list[str], col: str = "cluster") -> DataFrame:
    """CLU-07: Davies-Bouldin and Calinski-Harabasz from per-cluster sums
    (noise -1 removed; null when fewer than 2 clusters)."""
    d = assigned.where(F.col(col) != -1)
    aggs = [F.count(F.lit(1)).alias("n")] + [F.avg(q(f)).alias(f"m{i}") for i, f in enumerate(features)]
    cents = {r[col]: r for r in d.groupBy(col).agg(*aggs).collect()}  # k rows
    k = len(cents)
    if k < 2:
        return d.sparkSession.createDataFrame([(None, None, k)], "davies_bouldin double, calinski_harabasz double, "
                                                                "clusters int")
    keys = sorted(cents)
    cvec = {c: np.array([cents[c][f"m{i}"] for i in range(len(features))]) for c in keys}
    m = F.create_map(*[x for c in keys for x in (F.lit(c), F.array(*[F.lit(float(v)) for v in cvec[c]]))])
    cen = F.element_at(m, F.col(col))
    dist = F.sqrt(sum((q(f) - cen[i]) ** 2 for i, f in enumerate(features)))
    sq = sum((q(f) - cen[i]) ** 2 for i, f in enumerate(features))
    s = {r[col]: r for r in d.groupBy(col).agg(F.avg(dist).alias("s"), F.sum(sq).alias("w")).collect()}
    n = sum(cents[c]["n"] for c in keys)
    overall = sum(cvec[c] * cents[c]["n"] for c in keys) / n
    between = sum(cents[c]["n"] * float(((cvec[c] - overall) ** 2).sum()) for c in keys)
    within = sum(float(s[c]["w"]) for c in keys)
    ch = (between / (k - 1)) / (within / (n - k)) if within else None
    db = 0.0
    for a in keys:
        worst = 0.0
        for b in keys:
            if a == b:
                continue
            dab = float(np.sqrt(((cvec[a] - cvec[b]) ** 2).sum()))
            worst = max(worst, (s[a]["s"] + s[b]["s"]) / dab if dab else math.inf)
        db += worst
    return d.sparkSession.createDataFrame([(db / k, ch, k)], "davies_bouldin double, calinski_harabasz double, "
                                                            "clusters int")


def silhouette(assigned: DataFrame, features: list[str], col: str = "cluster") -> float:
    """CLU-06: spark.ml silhouette over all rows (squared Euclidean), noise and rows without a cluster
    removed. ``density.silhouette_rows`` has the Euclidean form."""
    ev = ClusteringEvaluator(featuresCol="features", predictionCol=col)
    d = assigned if "features" in assigned.columns else _vec(assigned, features)
    return float(ev.evaluate(cut_lineage(d.where((F.col(col) != -1) & F.col("features").isNotNull()).select("features", col))))


def elbow(df: DataFrame, features: list[str], ks=range(2, 11), seed: int = 42) -> DataFrame:
    """CLU-05: k-means for every k: inertia (training cost) and silhouette;
    best k = largest silhouette. The fits share one cached table and run side by side."""
    d = _vec(df, features).where(F.col("features").isNotNull()).select("features").persist()
    ev = ClusteringEvaluator(featuresCol="features", predictionCol="prediction")

    def one(k):
        model = KMeans(k=k, seed=seed).fit(d)
        return k, float(model.summary.trainingCost), float(ev.evaluate(model.transform(d)))

    d.count()
    with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
        rows = list(pool.map(one, ks))
    d.unpersist()
    best = max(rows, key=lambda r: r[2])[0]
    return df.sparkSession.createDataFrame([(k, i, s, k == best) for k, i, s in rows],
                                           "k int, inertia double, silhouette double, best boolean")


METHODS = ("kmeans", "bisecting", "gmm", "dbscan")


def compare_methods(df: DataFrame, key: str, features: list[str], k: int = 3, eps: float = 0.5, min_samples: int = 5, seed: int = 42) -> DataFrame:
    """CLU-09: per method clusters, noise rows, the largest and smallest cluster and the Euclidean
    silhouette of the sample; ``best`` marks the largest silhouette (ties to the first method)."""
    from .density import dbscan, silhouette_rows
    x = cut_lineage(df.select(q(key), point(df, features).alias("x")))  # every method reads it

    def one(method):
        if method == "dbscan":
            a = cut_lineage(x.join(dbscan(x, key, ["x"], eps, min_samples).drop("kind"), key))
        else:
            a = fit_clusters(x, ["x"], method, k, seed)[1].drop("features")
        sizes = cluster_sizes(a.where(F.col("cluster").isNotNull()))
        inner = F.when(F.col("cluster") != -1, F.col("size"))
        r = sizes.agg(F.count(inner).alias("clusters"), F.sum(F.when(F.col("cluster") == -1, F.col("size"))).alias("noise"), F.min(inner).alias("smallest"), F.max(inner).alias("largest")).first()
        s = silhouette_rows(a, key, ["x"], seed=seed).agg(F.avg("silhouette")).first()[0]
        return method, int(r["clusters"]), int(r["noise"] or 0), r["smallest"], r["largest"], s

    rows = [one(m) for m in METHODS]
    best = max((r for r in rows if r[-1] is not None), key=lambda r: r[-1], default=(None,))[0]
    return df.sparkSession.createDataFrame([(*r, r[0] == best) for r in rows], "method string, clusters int, noise long, smallest long, largest long, silhouette double, best boolean")


def pca_view(df: DataFrame, features: list[str], key: str, n: int = 2000, seed: int = 42) -> DataFrame:
    """CLU-11: 2-D coordinates of a PCA fitted on all rows, for a seeded sample of <= n of them."""
    from ..operators.charts import sample_rows
    from ..operators.prep import pca
    _, apply = pca(df, features, 2, scale=True)
    return apply(sample_rows(df, key, n, seed))
