"""Explanations (EXP-01/02/03/05/06) and model utilities (MDL-19/20/21,
PRE-16/17, STA-08).

All row work is distributed: permutation importance re-pairs a column by a
seeded md5 rank (a join on rank, no shuffle of values through the driver);
partial dependence explodes a literal grid onto each sampled row (no join);
linear SHAP is column arithmetic plus one aggregate.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import q, uniform
from ..session import cut_lineage
from . import metrics as M
from .models import _labelled, class_codes, estimator, fit_predict
from .prep import assign_folds, class_ranks, fit_prep, split, transform
from .ranks import exact_quantiles

PDP_POINTS = 20
PERM_REPEATS = 5
FIT_ROWS = 500_000  # training rows of a task, as expected at most


def _prepare(df: DataFrame, features: list[str], target: str, task: str, codes: DataFrame | None) -> DataFrame:
    """(features, label) of the rows with a known target and no gap in a feature. Columns that
    bear the name of a model's output give way."""
    labelled = _labelled(df, target, task, codes).where(F.col("label").isNotNull()).dropna(subset=features)
    labelled = labelled.drop(*{"features", "prediction", "probability", "rawPrediction"} - set(features))
    return VectorAssembler(inputCols=features, outputCol="features").transform(labelled)


def fit_parts(stored: DataFrame) -> DataFrame:
    """A stored table in parts of at most about ``FIT_ROWS`` rows: a forest keeps a count per tree
    with every row, so a task reads several times what is stored."""
    parts = -(-stored.count() // FIT_ROWS)
    return cut_lineage(stored.repartition(parts)) if stored.rdd.getNumPartitions() < parts else stored


def fit_model(train: DataFrame, features: list[str], target: str, name: str, task: str = "classification"):
    """A fitted model and its classes as a table (value, label); None for regression."""
    codes = class_codes(train, target) if task == "classification" else None
    tr = fit_parts(cut_lineage(_prepare(train, features, target, task, codes).select("features", "label")))  # a fit reads it several times
    return estimator(name, task, len(features), codes.count() if codes is not None else 0).fit(tr), codes


def native_importance(model, features: list[str]) -> list[tuple[str, float]]:
    """EXP-02: tree feature importances, or mean |coefficient| for linear
    models, as shares summing to 1."""
    if hasattr(model, "featureImportances"):
        v = list(model.featureImportances.toArray())
    elif hasattr(model, "coefficientMatrix"):
        m = model.coefficientMatrix.toArray()
        v = list(abs(m).mean(axis=0))
    else:
        v = [abs(x) for x in model.coefficients.toArray()]
    tot = sum(v) or 1.0
    return [(f, float(float(x) / float(tot))) for f, x in zip(features, v)]


def linear_shap(df: DataFrame, train: DataFrame, features: list[str], coefs: list[float]) -> DataFrame:
    """EXP-03: phi_j = w_j (x_j - mean_train(x_j)); returns mean |phi| per
    feature over all rows of ``df`` (one aggregate)."""
    means = train.agg(*[F.avg(q(f)).alias(f"m{i}") for i, f in enumerate(features)]).first()
    phis = [(F.lit(float(w)) * (q(f).cast("double") - F.lit(float(means[f"m{i}"])))) for i, (f, w) in
            enumerate(zip(features, coefs))]
    r = df.agg(*[F.avg(F.abs(p)).alias(f"p{i}") for i, p in enumerate(phis)]).first()
    return df.sparkSession.createDataFrame([(f, float(r[f"p{i}"])) for i, f in enumerate(features)],
                                           "feature string, mean_abs_shap double")


def partial_dependence(model, df: DataFrame, features: list[str], feature: str, key: str,
                       points: int = PDP_POINTS) -> DataFrame:
    """EXP-06: average prediction (positive-class probability when present)
    with ``feature`` set to each of ``points`` grid values between its 5 %
    and 95 % quantiles, over all rows without a gap in a feature (every row is scored
    ``points`` times and enters one grouped mean)."""
    qs = exact_quantiles(df.select(q(feature).cast("double").alias("value")), [0.05, 0.95]).first()
    lo, hi = float(qs["q_0"]), float(qs["q_1"])
    grid = [lo + (hi - lo) * i / (points - 1) for i in range(points)] if hi > lo else [lo]
    e = df.dropna(subset=[f for f in features if f != feature]).withColumn("__grid", F.explode(F.array(*[F.lit(g) for g in grid]))).withColumn(feature, F.col("__grid"))
    d = VectorAssembler(inputCols=features, outputCol="features").transform(e)
    out = model.transform(d)
    val = vector_to_array("probability")[1] if "probability" in out.columns else F.col("prediction")
    return out.groupBy(F.col("__grid").alias("value")).agg(F.avg(val).alias("mean_prediction"))


def permutation_importance(model, test: DataFrame, features: list[str], target: str, key: str,
                           classes=None, repeats: int = PERM_REPEATS, seed: int = 42) -> DataFrame:
    """EXP-01: drop in accuracy (classification) or R2 (regression) when one
    column's values are re-paired with other rows: rows ranked by md5(seed, key)
    receive the value of the row ranked by md5(seed + 1000 + r, key).

    Rows are ranked once per repeat; every (feature, repeat) variant of a row is made where the
    row is and all are scored in one pass, with one grouped count."""
    task = "regression" if classes is None else "classification"
    table = cut_lineage(_prepare(test, features, target, task, classes).select(q(key).alias("__key"), "label", F.array(*[q(f).cast("double") for f in features]).alias("__x")))
    own = class_ranks(table, "__key", seed).select("__rank", "label", "__x")
    given = None
    for r in range(repeats):
        other = class_ranks(table, "__key", seed + 1000 + r).select(F.col("__rank"), F.lit(r).alias("repeat"), F.col("__x").alias("__z"))
        given = other if given is None else given.union(other)
    swapped = []
    for i in range(len(features)):
        x = F.array(*[F.col("__z")[j] if j == i else F.col("__x")[j] for j in range(len(features))])
        swapped.append(F.struct(F.lit(i).alias("feature"), x.alias("x")))
    pairs = own.join(given, "__rank").select("label", "repeat", F.explode(F.array(*swapped)).alias("v"))
    plain = own.select("label", F.lit(-1).alias("repeat"), F.lit(-1).alias("feature"), F.col("__x").alias("x"))
    rows = pairs.select("label", "repeat", "v.feature", "v.x").union(plain)
    scored = model.transform(rows.withColumn("features", array_to_vector("x")))
    if classes is not None:
        found = {k: m["accuracy"] for k, m in M.grouped_classification_metrics(scored, ["feature", "repeat"]).items()}
    else:
        gap = F.col("label") - F.col("prediction")
        found = {(r["feature"], r["repeat"]): 1 - r["e"] / r["v"] for r in scored.groupBy("feature", "repeat").agg(F.avg(gap * gap).alias("e"), F.var_pop("label").alias("v")).collect()}
    rows = []
    for i, f in enumerate(features):
        drops = [found[-1, -1] - found[i, r] for r in range(repeats)]
        rows.append((f, float(sum(drops) / len(drops)), float(min(drops)), float(max(drops))))
    return test.sparkSession.createDataFrame(rows, "feature string, mean_drop double, min_drop double, max_drop double")


def grid_search(df: DataFrame, features: list[str], target: str, name: str, grid: list[dict], key: str, k: int = 3,
                task: str = "classification", seed: int = 42) -> DataFrame:
    """MDL-19: every parameter set on the same md5 folds; mean metric per set."""
    if len(grid) > 500:
        raise ValueError("at most 500 parameter sets")
    folded = cut_lineage(assign_folds(df, key, k, seed, target if task == "classification" else None)).persist()  # in as many parts as its size asks for
    rows = []
    for i, params in enumerate(grid):
        vals = []
        for f in range(k):
            p = fit_predict(folded.where(F.col("fold") != f), folded.where(F.col("fold") == f), features, target,
                            name, task, params, key)
            if task == "classification":
                vals.append(M.classification_metrics(p, "label", "prediction").first()["accuracy"])
            else:
                vals.append(M.regression_metrics(p, "label", "prediction", len(features)).first()["r2"])
        rows.append((i, str(sorted(params.items())), float(sum(vals) / k)))
    folded.unpersist()
    return df.sparkSession.createDataFrame(rows, "set int, params string, mean_score double")


def learning_curve(df: DataFrame, features: list[str], target: str, name: str, key: str,
                   sizes=(0.1, 0.325, 0.55, 0.775, 1.0), seed: int = 42) -> DataFrame:
    """MDL-20: nested training subsets (the rows with the smallest md5 keys)
    scored on one locked test split."""
    s = cut_lineage(split(df.select(*[q(c) for c in dict.fromkeys([key, target, *features])]), key, 0.2, seed, target))  # ranked once, read by every size
    tr, te = s.where(F.col("__split__") == "train"), s.where(F.col("__split__") == "test")
    tr = tr.withColumn("__u2", uniform(seed + 7, q(key)))
    rows = []
    n = tr.count()
    for frac in sizes:
        sub = tr.where(F.col("__u2") < F.lit(float(frac))) if frac < 1 else tr
        p = fit_predict(sub, te, features, target, name, key=key)
        acc = M.classification_metrics(p, "label", "prediction").first()["accuracy"]
        rows.append((float(frac), int(round(frac * n)), float(acc)))
    return df.sparkSession.createDataFrame(rows, "size double, approx_rows long, accuracy double")


def validation_holdout(df: DataFrame, key: str, share: float = 0.1, seed: int = 42, target: str | None = None):
    """PRE-17: hold back a validation share before any preprocessing."""
    s = split(df.withColumn("__v", F.lit(1)), key, share, seed + 101, target).drop("__v")
    return (s.where(F.col("__split__") == "train").drop("__split__"),
            s.where(F.col("__split__") == "test").drop("__split__"))


def apply_plan(df: DataFrame, plan: dict, key: str, target: str, test_size: float = 0.2, seed: int = 42,
               stratify: bool = True) -> tuple[DataFrame, dict]:
    """PRE-16: split -> fit on train -> replay on both -> tagged union."""
    s = split(df, key, test_size, seed, target if stratify else None)
    state = fit_prep(s.where(F.col("__split__") == "train"), plan, key)
    return transform(state, s), state


def predict_table(model, state: dict | None, df: DataFrame, features: list[str], classes: DataFrame | None,
                  key: str) -> DataFrame:
    """MDL-21: replay preprocessing, score, map class codes back to names,
    probabilities rounded to 6 digits. One row per row of ``df``; null where a feature is."""
    d = transform(state, df) if state else df
    whole = F.lit(True)
    for f in features:
        whole = whole & q(f).isNotNull()
    v = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(d.withColumn("__whole", whole))
    out = model.transform(v)
    known = lambda c: F.when(F.col("__whole"), c)
    cols = [q(key)]
    if classes is not None:
        names = [r["value"] for r in classes.orderBy("label").collect()]  # one per class
        cols.append(known(F.element_at(F.array(*map(F.lit, names)), F.col("prediction").cast("int") + 1)).alias("prediction"))
        if "probability" in out.columns:
            arr = vector_to_array("probability")
            cols += [known(F.round(arr[i], 6)).alias(f"probability {c}") for i, c in enumerate(names)]
    else:
        cols.append(known(F.col("prediction")).alias("prediction"))
    return out.select(*cols)


def normality_table(df: DataFrame, columns: list[str], by: str | None = None) -> DataFrame:
    """STA-08: per column (and group) n, skewness, kurtosis and Shapiro-Wilk."""
    from .profile import numeric_moments
    from .stats import shapiro_by_group
    g = q(by).cast("string") if by else F.lit("all")
    parts = []
    for c in columns:
        d = df.select(g.alias("g"), q(c).cast("double").alias("y")).where(F.col("y").isNotNull())
        sw = shapiro_by_group(d)
        mom = numeric_moments(d, ["y"], by=["g"]).select("g", "skew", "kurtosis")
        parts.append(sw.join(mom, "g").select(F.lit(c).alias("column"), F.col("g").alias("group"), "n", "skew",
                                               "kurtosis", F.col("W").alias("shapiro_w"),
                                               F.col("p").alias("shapiro_p"), "note"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


LIME_SAMPLES = 5000
LIME_ALPHA = 1.0


def lime(model, train: DataFrame, rows: DataFrame, features: list[str], key: str, samples: int = LIME_SAMPLES,
         seed: int = 42) -> DataFrame:
    """EXP-07: per explained row, ``samples`` variants in which a uniform number of
    columns, chosen at random, takes the values of a random row of ``train``; scored by the
    model; kernel sqrt(exp(-d^2 / w^2)) with w = 0.75 sqrt(p); weighted ridge (alpha = 1)
    per row in ``applyInPandas``; returns coefficients and the weighted R^2. All draws
    come from md5 keys. Work grows with rows x samples, both parameters."""
    import numpy as np
    import pandas as pd
    p = len(features)
    ground = class_ranks(train.dropna(subset=features).select(q(key).alias("__bk"), *[q(f).cast("double").alias(f"__b_{f}") for f in features]), "__bk", seed)
    ground = ground.select(F.col("__rank").cast("long").alias("__at"), *[f"__b_{f}" for f in features]).persist()
    n = ground.count()
    e = rows.select(q(key).alias("__row"), *[q(f).cast("double").alias(f) for f in features]).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("__s"))
    draw = lambda what: uniform(f"{seed}-{what}", F.col("__row"), F.col("__s"))
    order = F.array_sort(F.array(*[F.struct(draw(f"order{i}").alias("u"), F.lit(i).alias("i")) for i in range(p)]))
    swapped = F.transform(F.slice(order, 1, (F.floor(draw("number") * p) + 1).cast("int")), lambda x: x["i"])
    e = (e.withColumn("__swap", F.when(F.col("__s") == 0, F.array().cast("array<int>")).otherwise(swapped))
         .withColumn("__at", (F.floor(draw("row") * n) + 1).cast("long")).join(ground, "__at"))
    keep = [~F.array_contains("__swap", i) for i in range(p)]
    e = e.select("__row", "__s", *[F.when(kp, F.col(f)).otherwise(F.col(f"__b_{f}")).alias(f) for kp, f in zip(keep, features)],
                 *[kp.cast("double").alias(f"__z{i}") for i, kp in enumerate(keep)])
    d = VectorAssembler(inputCols=features, outputCol="features").transform(e)
    out = model.transform(d)
    val = vector_to_array("probability")[1] if "probability" in out.columns else F.col("prediction")
    scored = out.select("__row", *[f"__z{i}" for i in range(p)], val.alias("__y"))
    width = 0.75 * np.sqrt(p)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        z = pdf[[f"__z{i}" for i in range(p)]].to_numpy()
        y = pdf["__y"].to_numpy()
        dist = np.sqrt(((1 - z) ** 2).sum(axis=1))
        w = np.sqrt(np.exp(-(dist ** 2) / width ** 2))
        xm = np.hstack([np.ones((len(z), 1)), z])
        a = xm.T @ (xm * w[:, None]) + LIME_ALPHA * np.diag([0.0] + [1.0] * p)
        beta = np.linalg.solve(a, xm.T @ (w * y))
        fit = xm @ beta
        ybar = (w * y).sum() / w.sum()
        r2 = 1 - (w * (y - fit) ** 2).sum() / max((w * (y - ybar) ** 2).sum(), 1e-300)
        return pd.DataFrame([{"row": pdf["__row"].iloc[0], "feature": f, "weight": float(b), "score": float(r2)}
                             for f, b in zip(features, beta[1:])])
    kt = rows.schema[key].dataType.simpleString()
    return scored.groupBy("__row").applyInPandas(solve, f"row {kt}, feature string, weight double, score double")
