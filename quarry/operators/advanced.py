"""Iterative imputation (PRE-02), recursive feature elimination (PRE-08),
AdaBoost (MDL-07) and isolation-forest outlier removal (PRE-03).

The isolation forest grows its trees in parallel tasks: every tree gets its
own seeded 256-row sample (rows ranked by md5 inside each tree id), a grouped
``applyInPandas`` builds one tree per group, the (small, bounded) trees are
broadcast and every row is scored by ``mapInPandas``.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import q, uniform
from ..session import cut_lineage
from .models import class_codes
from .ranks import exact_quantiles

N_TREES = 100
TREE_SAMPLE = 256
CONTAMINATION = 0.05


# ---- PRE-02 iterative imputation ---------------------------------------------------------

def iterative_impute(train: DataFrame, columns: list[str], max_iter: int = 10, tol: float = 1e-3) -> dict:
    """Chained regressions fitted on TRAIN: gaps start at the column means; each column
    with gaps is regressed on the others' current values (rows where it is known) and
    refilled before the next column's turn. Rounds end when no coefficient moves by
    ``tol``. Returns a JSON-able state for ``apply_iterative``."""
    from ..session import cut_lineage
    seen = train.agg(*[F.avg(q(c)).alias(f"m{i}") for i, c in enumerate(columns)], *[F.count_if(q(c).isNull()).alias(f"g{i}") for i, c in enumerate(columns)]).first()
    state = {"columns": columns, "means": {c: seen[f"m{i}"] for i, c in enumerate(columns)}, "gaps": [c for i, c in enumerate(columns) if seen[f"g{i}"]], "models": {}, "rounds": 0}
    filled = cut_lineage(_start(state, train))
    for _ in range(max_iter):
        change = 0.0
        for c in state["gaps"]:
            others = [o for o in columns if o != c]
            rows = VectorAssembler(inputCols=others, outputCol="features").transform(filled.where(f"`__gap_{c}` = false").select(*others, q(c).alias("label")))
            m = LinearRegression(regParam=1e-6, elasticNetParam=0.0).fit(rows)
            new = [float(m.intercept), *map(float, m.coefficients)]
            change = max([change, *(abs(a - b) for a, b in zip(new, state["models"].get(c, [state["means"][c]] + [0.0] * len(others))))])
            state["models"][c] = new
            filled = _refill(state, filled, c)
        filled = cut_lineage(filled)
        state["rounds"] += 1
        if change < tol:
            break
    return state


def _start(state: dict, df: DataFrame) -> DataFrame:
    """Gaps marked (__gap_<column>) and filled with the means."""
    cols = state["columns"]
    return df.withColumns({f"__gap_{c}": q(c).isNull() for c in cols}).withColumns({c: F.coalesce(q(c).cast("double"), F.lit(state["means"][c])) for c in cols})


def _refill(state: dict, df: DataFrame, c: str) -> DataFrame:
    first, *weights = state["models"][c]
    guess = F.lit(first)
    for o, w in zip([o for o in state["columns"] if o != c], weights):
        guess = guess + F.lit(w) * q(o)
    return df.withColumn(c, F.when(F.col(f"`__gap_{c}`"), guess).otherwise(q(c)))


def apply_iterative(state: dict, df: DataFrame) -> DataFrame:
    """Fill the gaps of new rows: means, then the fitted chain as often as in fitting."""
    out = _start(state, df)
    for _ in range(state["rounds"]):
        for c in state["gaps"]:
            out = _refill(state, out, c)
    return out.drop(*[f"__gap_{c}" for c in state["columns"]])


# ---- PRE-08 recursive feature elimination ---------------------------------------------------

def rfe(train: DataFrame, features: list[str], label: str, k: int, task: str = "classification") -> DataFrame:
    """Drop the feature with the smallest |coefficient| (standardised inputs)
    one at a time until ``k`` remain; returns the elimination order."""
    sd = train.agg(*[F.stddev_samp(q(f)).alias(f) for f in features]).first().asDict()
    mu = train.agg(*[F.avg(q(f)).alias(f) for f in features]).first().asDict()
    z = train.select(*[((q(f) - F.lit(mu[f])) / F.lit(sd[f] or 1.0)).alias(f) for f in features],
                     q(label).cast("double").alias("label")).persist()
    keep, order = list(features), []
    while len(keep) > k:
        d = VectorAssembler(inputCols=keep, outputCol="features").transform(z)
        est = LogisticRegression(maxIter=50) if task == "classification" else LinearRegression()
        fitted = est.fit(d)  # one row of coefficients per class, or one in all
        w = np.sqrt((fitted.coefficientMatrix.toArray() ** 2).sum(axis=0)) if task == "classification" else np.abs(fitted.coefficients.toArray())
        weakest = keep[int(np.argmin(w))]
        order.append(weakest)
        keep.remove(weakest)
    z.unpersist()
    rows = [(f, i + 1, False) for i, f in enumerate(order)] + [(f, None, True) for f in keep]
    return train.sparkSession.createDataFrame(rows, "feature string, eliminated_step int, selected boolean")


# ---- MDL-07 AdaBoost (SAMME, stumps) ----------------------------------------------------

def adaboost(train: DataFrame, features: list[str], label: str, n_estimators: int = 50):
    """SAMME with depth-1 trees; sample weights updated with column
    arithmetic each round. Returns [(stump model, alpha)] and the classes."""
    classes = [r["value"] for r in class_codes(train, label).orderBy("label").collect()]
    k = len(classes)
    m = F.create_map(*[x for i, c in enumerate(classes) for x in (F.lit(c), F.lit(float(i)))])
    d = VectorAssembler(inputCols=features, outputCol="features").transform(train).withColumn(
        "__y", F.element_at(m, q(label).cast("string"))).select("features", F.col("__y").alias("label"))
    d = cut_lineage(d)  # the joins behind ``train`` run once
    n = d.count()
    d = d.withColumn("w", F.lit(1.0 / n)).select("features", "label", "w").persist()
    ensemble = []
    for it in range(n_estimators):
        if it and it % 10 == 0:  # reliable checkpoint in spark.checkpoint.dir keeps lineage short
            old, d = d, cut_lineage(d)
            old.unpersist()
        stump = DecisionTreeClassifier(maxDepth=1, weightCol="w").fit(d)
        p = stump.transform(d).select("features", "label", "w", "prediction")
        err = p.agg((F.sum(F.when(F.col("prediction") != F.col("label"), F.col("w")).otherwise(0.0))
                     / F.sum("w")).alias("e")).first()["e"]
        if err >= 1 - 1.0 / k:
            break
        alpha = math.log((1 - err) / max(err, 1e-12)) + math.log(k - 1)
        ensemble.append((stump, alpha))
        if err <= 0 or len(ensemble) == n_estimators:  # no further round reads the weights
            break
        nd = p.select("features", "label", (F.col("w") * F.when(F.col("prediction") != F.col("label"),
                                                                F.lit(math.exp(alpha))).otherwise(1.0)).alias("w"))
        tot = nd.agg(F.sum("w")).first()[0]
        d2 = nd.select("features", "label", (F.col("w") / F.lit(tot)).alias("w")).persist()
        d2.count()  # stored before the weights it comes from are let go, else every round starts from the first one
        d.unpersist()
        d = d2
    d.unpersist()
    return ensemble, classes


def adaboost_predict(ensemble, classes, df: DataFrame, features: list[str]) -> DataFrame:
    """Weighted vote of the stumps (sum of alpha per predicted class)."""
    d = VectorAssembler(inputCols=features, outputCol="features").transform(df)
    score = [F.lit(0.0)] * len(classes)
    for i, (stump, alpha) in enumerate(ensemble):
        d = stump.setPredictionCol(f"__p{i}").setRawPredictionCol(f"__r{i}").setProbabilityCol(
            f"__pr{i}").transform(d)
        score = [s + F.when(F.col(f"__p{i}") == float(c), F.lit(alpha)).otherwise(0.0)
                 for c, s in enumerate(score)]
    arr = F.array(*score)
    best = F.array_position(arr, F.array_max(arr)) - 1
    lab = F.array(*[F.lit(c) for c in classes])
    return d.withColumn("prediction", F.element_at(lab, (best + 1).cast("int"))).drop(
        *[c for c in d.columns if c.startswith("__")], "features")


# ---- PRE-03 isolation forest ----------------------------------------------------------------

def _c(n: float) -> float:
    """Average path length of an unsuccessful BST search."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int):
    """Array form of one isolation tree: (feature, threshold, left, right, size)."""
    feat, thr, left, right, size = [], [], [], [], []

    def node(idx, depth):
        i = len(feat)
        feat.append(-1), thr.append(0.0), left.append(-1), right.append(-1), size.append(len(idx))
        if depth >= limit or len(idx) <= 1:
            return i
        sub = x[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        cand = np.where(hi > lo)[0]
        if len(cand) == 0:
            return i
        f = int(rng.choice(cand))
        t = float(rng.uniform(lo[f], hi[f]))
        feat[i], thr[i] = f, t
        m = sub[:, f] < t
        left[i] = node(idx[m], depth + 1)
        right[i] = node(idx[~m], depth + 1)
        return i
    node(np.arange(len(x)), 0)
    return {"feat": feat, "thr": thr, "left": left, "right": right, "size": size}


def _flat(tree: dict):
    """(feature, threshold, children, path length, depth) of a tree's nodes: node i leads to
    ``children[2 i + 1]`` below its threshold, else to ``children[2 i]``; a leaf leads to itself."""
    feat, thr, left, right = (np.asarray(tree[k]) for k in ("feat", "thr", "left", "right"))
    at = np.arange(len(feat))
    child = np.stack([np.where(feat < 0, at, right), np.where(feat < 0, at, left)], axis=1).ravel()
    depth = np.zeros(len(feat))
    for i in at[feat >= 0].tolist():  # a node comes before its children
        depth[[left[i], right[i]]] = depth[i] + 1
    length = depth + np.array([_c(int(n)) for n in tree["size"]])
    return np.maximum(feat, 0), thr, child, length, int(depth.max())


def isolation_scores(train: DataFrame, df: DataFrame, features: list[str], key: str, n_trees: int = N_TREES,
                     sample: int = TREE_SAMPLE, seed: int = 42) -> DataFrame:
    """Anomaly score 2^(-E[h(x)] / c(sample)) for every row of ``df`` from a
    forest grown on ``train``. Each tree's sample: the ``sample`` train rows
    with the smallest md5(seed + tree, key); grown in its own task."""
    n = train.count()
    psi = min(sample, n)
    frac = min(1.0, (psi * 1.5 + 20) / max(n, 1))
    # a bounded pool first (about n_trees x 1.5 x sample rows), then a seeded
    # per-tree draw from it: rows are never replicated n_trees times
    pool = min(1.0, n_trees * (psi * 1.5 + 20) / max(n, 1))
    trees_in = (train.select(q(key).alias("__k"), *[q(f).cast("double").alias(f) for f in features])
                .where(uniform(seed + 1, F.col("__k")) < F.lit(pool))
                .select("*", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))).alias("tree"))
                .withColumn("__u", uniform(seed, F.col("tree"), F.col("__k")))
                .where(F.col("__u") < F.lit(min(1.0, frac / pool))))
    from pyspark.sql import Window
    trees_in = trees_in.withColumn("__r", F.row_number().over(Window.partitionBy("tree").orderBy("__u"))) \
        .where(F.col("__r") <= psi)
    limit = int(math.ceil(math.log2(max(psi, 2))))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        rng = np.random.default_rng(seed * 100003 + t)
        tree = _grow(pdf[features].to_numpy(dtype=float), rng, limit)
        return pd.DataFrame([{"tree": t, "spec": json.dumps(tree)}])
    specs = [json.loads(r["spec"]) for r in trees_in.groupBy("tree").applyInPandas(build, "tree int, spec string")
             .collect()]  # n_trees small arrays (bounded by n_trees x 2^limit nodes)
    bc = df.sparkSession.sparkContext.broadcast(specs)
    cn = _c(psi)

    def score(batches):
        forest = [_flat(t) for t in bc.value]
        for pdf in batches:
            n = len(pdf)
            x, rows = np.concatenate([pdf[f].to_numpy(dtype=float) for f in features]), np.arange(n)
            h = np.zeros(n)
            for feat, thr, child, length, depth in forest:
                idx = np.zeros(n, dtype=np.int64)
                for _ in range(depth):
                    idx = child[2 * idx + (x[feat[idx] * n + rows] < thr[idx])]
                h += length[idx]
            h = h / max(len(forest), 1)
            yield pd.DataFrame({key: pdf[key], "anomaly_score": np.power(2.0, -h / cn) if cn else 0.5})
    kt = df.schema[key].dataType.simpleString()
    return df.select(q(key), *[q(f).cast("double").alias(f) for f in features]).mapInPandas(
        score, f"{key} {kt}, anomaly_score double")


def remove_isolated(train: DataFrame, features: list[str], key: str, contamination: float = CONTAMINATION,
                    seed: int = 42) -> DataFrame:
    """PRE-03: drop the TRAIN rows whose score is above the (1 - contamination)
    quantile of the train scores."""
    s = cut_lineage(isolation_scores(train, train, features, key, seed=seed))  # the quantile is found in several passes
    cut = exact_quantiles(s.select(F.col("anomaly_score").alias("value")), [1 - contamination]).first()["q_0"]
    keep = s.where(F.col("anomaly_score") <= F.lit(cut)).select(key)
    return train.join(keep, key, "left_semi")
