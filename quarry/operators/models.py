"""Models on spark.ml (MDL-01..21) and the train/evaluate loop.

Estimators are spark.ml (distributed fitting); the reference's scikit-learn
hyper-parameters map as documented per builder. Cross-validation uses the
md5 fold column (PRE-15), refits preprocessing inside every fold (leak-free),
and scores every fold with the aggregate metrics of ``metrics``.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.linalg import VectorUDT
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression,
                                       MultilayerPerceptronClassifier, NaiveBayes, OneVsRest,
                                       RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (DecisionTreeRegressor, GBTRegressor, LinearRegression,
                                   RandomForestRegressor)
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import q, uniform
from ..session import cut_lineage
from . import metrics as M
from .graph import numbered
from .prep import LOCAL_CLASSES, assign_folds, fit_prep, transform

CLASSIFIERS = ("baseline", "logistic", "naive_bayes", "decision_tree", "random_forest", "gbt", "linear_svc", "mlp")
REGRESSORS = ("baseline", "linear", "ridge", "lasso", "elastic_net", "decision_tree", "random_forest", "gbt")


def estimator(name: str, task: str, n_features: int, n_classes: int = 2, params: dict | None = None, seed: int = 42):
    """MDL-02..11: spark.ml estimator on (features, label[, weight])."""
    p = dict(params or {})
    if task == "classification":
        if name == "logistic":
            return LogisticRegression(maxIter=p.get("max_iter", 100), regParam=p.get("reg", 0.0),  # else from C
                                      standardization=False)
        if name == "naive_bayes":
            return NaiveBayes(modelType=p.get("model_type", "gaussian"))
        if name == "decision_tree":
            return DecisionTreeClassifier(maxDepth=p.get("max_depth", 5), seed=seed)
        if name == "random_forest":
            return RandomForestClassifier(numTrees=p.get("n_estimators", 100), maxDepth=p.get("max_depth", 5),
                                          seed=seed)
        if name == "gbt":
            base = GBTClassifier(maxIter=p.get("n_estimators", 20), maxDepth=p.get("max_depth", 3), seed=seed)
            return base if n_classes == 2 else OneVsRest(classifier=base)
        if name == "linear_svc":
            base = LinearSVC(regParam=p.get("reg", 0.0), maxIter=p.get("max_iter", 100))
            return base if n_classes == 2 else OneVsRest(classifier=base)
        if name == "mlp":
            hidden = list(p.get("hidden", [16]))
            return MultilayerPerceptronClassifier(layers=[n_features, *hidden, n_classes], maxIter=p.get("max_iter", 50),
                                                  seed=seed)
    else:
        if name in ("linear", "ridge", "lasso", "elastic_net"):
            enet = {"linear": 0.0, "ridge": 0.0, "lasso": 1.0, "elastic_net": p.get("l1_ratio", 0.5)}[name]
            reg = 0.0 if name == "linear" else p.get("alpha", 1.0)
            return LinearRegression(regParam=reg, elasticNetParam=enet, standardization=False,
                                    solver="normal" if name == "linear" else "auto")
        if name == "decision_tree":
            return DecisionTreeRegressor(maxDepth=p.get("max_depth", 5), seed=seed)
        if name == "random_forest":
            return RandomForestRegressor(numTrees=p.get("n_estimators", 100), maxDepth=p.get("max_depth", 5), seed=seed)
        if name == "gbt":
            return GBTRegressor(maxIter=p.get("n_estimators", 50), maxDepth=p.get("max_depth", 3), seed=seed)
    raise ValueError(f"unknown model {name} for {task}")


FITS_AT_ONCE = 4  # models fitted side by side


def class_codes(df: DataFrame, target: str) -> DataFrame:
    """(value, label): the classes in order, numbered from 0. One row per class, however many:
    a few are a local table that joins send to every task (a shuffle by class would leave the
    whole table in as many tasks as there are classes), many are numbered by range partitions."""
    values = df.where(q(target).isNotNull()).select(q(target).cast("string").alias("value")).distinct()
    found = values.limit(LOCAL_CLASSES + 1).collect()
    if len(found) > LOCAL_CLASSES:
        return numbered(values, ["value"], "label").select("value", F.col("label").cast("double").alias("label"))
    return F.broadcast(df.sparkSession.createDataFrame([(v, float(i)) for i, v in enumerate(sorted(r["value"] for r in found))], "value string, label double"))


def _labelled(df: DataFrame, target: str, task: str, codes: DataFrame | None) -> DataFrame:
    """``df`` with ``label`` (a column of that name gives way); null where the target is null or of
    a class that ``codes`` does not know."""
    if task != "classification":
        return df.withColumn("label", q(target).cast("double"))
    known = codes.select(F.col("value").alias("__known"), F.col("label").alias("__label"))
    out = df.withColumn("__value", q(target).cast("string")).drop("label")
    return out.join(known, F.col("__value") == F.col("__known"), "left").withColumnRenamed("__label", "label").drop("__value", "__known")


def complete(df: DataFrame, features: list[str]):
    """Whether no feature of a row is missing."""
    whole = F.lit(True)
    for f in features:
        whole = whole & q(f).isNotNull()
        if not isinstance(df.schema[f].dataType, VectorUDT):
            whole = whole & ~F.isnan(q(f).cast("double"))
    return whole


def fit_predict(train: DataFrame, test: DataFrame, features: list[str], target: str, name: str,
                task: str = "classification", params: dict | None = None, key: str | None = None,
                codes: DataFrame | None = None, apply=None) -> DataFrame:
    """Fit on train, predict test: (key, label, prediction[, probability]). ``apply`` (a function of
    the model and the rows) stands in for the model's own predictions.

    Training leaves out rows without a target or with a gap in a feature. Every test row
    has a row in the result; where a feature is null the prediction is null. ``codes`` are the
    classes if they are known already. ``params["class_weight"] = "balanced"`` weights the
    training rows of a class by n / (classes * rows of the class) (PRE-09)."""
    params = dict(params or {})
    if task == "classification" and codes is None:
        codes = class_codes(train, target)
    n_classes = codes.count() if codes is not None else 0
    own = [f"__f{i}" for i in range(len(features))]  # no name of the table meets one of ours

    def narrow(df):
        return df.select(*([q(key)] if key else []), *[q(f).alias(o) for f, o in zip(features, own)], q(target).alias("__target"))

    te = _labelled(narrow(test), "__target", task, codes)
    tr = _labelled(narrow(train), "__target", task, codes).where(F.col("label").isNotNull())
    keep = [*([key] if key else []), "label"]
    if name == "baseline":  # MDL-01
        guess = (tr.groupBy("label").count().orderBy(F.desc("count"), "label").first()["label"] if task == "classification"
                 else tr.agg(F.avg("label")).first()[0])
        return te.select(*keep, F.lit(float(guess)).alias("prediction"))
    whole = complete(te, own)
    va = VectorAssembler(inputCols=own, outputCol="features")
    tr = va.transform(tr.where(whole))
    est = estimator(name, task, len(features), n_classes, params)
    if params.get("class_weight") == "balanced":
        per = {r["label"]: r["count"] for r in tr.groupBy("label").count().collect()}
        weights = F.create_map(*[F.lit(x) for c, n in per.items() for x in (c, sum(per.values()) / (len(per) * n))])
        tr, est = tr.withColumn("__weight", F.element_at(weights, F.col("label"))), est.setWeightCol("__weight")
    if name in ("logistic", "linear_svc") and "reg" not in params:  # a sum of losses there, a mean here
        (est.getClassifier() if isinstance(est, OneVsRest) else est).setRegParam(1.0 / (float(params.get("C", 1.0)) * max(tr.count(), 1)))
    elif name in ("ridge", "elastic_net"):
        # Spark divides outcomes by their standard deviation s and so the squared penalty too
        size = tr.agg(F.count("*").alias("n"), F.stddev_pop("label").alias("s")).first()
        alpha, s = float(params.get("alpha", 1.0)), size["s"] or 1.0
        if name == "ridge":
            est = est.setRegParam(alpha * s / max(size["n"], 1))
        else:
            l1 = float(params.get("l1_ratio", 0.5))
            whole_penalty = l1 + s * (1 - l1)
            est = est.setRegParam(alpha * whole_penalty).setElasticNetParam(l1 / whole_penalty)
    model, te_whole = est.fit(tr), va.transform(te.where(whole))
    out = apply(model, te_whole) if apply else model.transform(te_whole)
    shown = [*keep, "prediction"]
    if "probability" in out.columns and task == "classification" and n_classes == 2:
        out, shown = out.withColumn("p1", vector_to_array("probability")[1]), [*shown, "p1"]
    unscored = te.where(~whole).select(*keep, *[F.lit(None).cast(out.schema[c].dataType).alias(c) for c in shown[len(keep):]])
    return out.select(*shown).union(unscored)


def cross_validate(df: DataFrame, features: list[str], target: str, models: list[str], key: str, k: int = 5,
                   task: str = "classification", plan: dict | None = None, seed: int = 42,
                   stratify: bool = True) -> DataFrame:
    """MDL-18 + EVL-07: per model and fold the primary metrics; a failing
    model is reported, the run continues. Preprocessing (``plan``) is fitted
    on each fold's training rows only. Models are fitted fold by fold; the
    out-of-fold predictions of every (model, fold) are then scored together
    with one grouped count and one grouped rank-AUC."""
    spark = df.sparkSession
    folded = cut_lineage(assign_folds(df, key, k, seed, target if (stratify and task == "classification") else None)).persist()  # in as many parts as its size asks for
    codes = class_codes(folded, target) if task == "classification" else None

    def parts(f):
        tr, te = folded.where(F.col("fold") != f), folded.where(F.col("fold") == f)
        if plan:
            st = fit_prep(tr, plan, key)
            tr, te = transform(st, tr), transform(st, te)
        return tr, te

    def fitted(job):
        name, f = job
        try:
            p = fit_predict(*sides[f], features, target, name, task, key=key, codes=codes)
            p1 = F.col("p1") if "p1" in p.columns else F.lit(None).cast("double")
            # scored here, so that a failure while predicting is this model's own
            return cut_lineage(p.select(F.lit(name).alias("model"), F.lit(f).alias("fold"), "label", "prediction", p1.alias("p1")))
        except Exception as e:  # noqa: BLE001 - one failing model must not end the run
            return type(e).__name__

    with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
        sides = list(pool.map(parts, range(k)))
        jobs = [(name, f) for name in models for f in range(k)]
        done = list(zip(jobs, pool.map(fitted, jobs)))
    rows = [(name, f, "error:" + p, None) for (name, f), p in done if isinstance(p, str)]
    preds = [p for _, p in done if not isinstance(p, str)]
    if preds:
        allp = preds[0]
        for p in preds[1:]:
            allp = allp.unionByName(p)
        if task == "classification":
            for (name, f), mm in grouped_metrics(allp).items():
                rows += [(name, int(f), m, float(v)) for m, v in mm.items()]
            withp = allp.where(F.col("p1").isNotNull())
            for (name, f), auc in M.grouped_roc_auc(withp, ["model", "fold"]).items():
                if auc is not None:
                    rows.append((name, int(f), "roc_auc", float(auc)))
        else:
            g = allp.groupBy("model", "fold").agg(
                F.avg(F.abs(F.col("label") - F.col("prediction"))).alias("mae"),
                F.avg(F.pow(F.col("label") - F.col("prediction"), 2)).alias("mse"), F.var_pop("label").alias("vy"))
            for r in g.collect():
                rows += [(r["model"], int(r["fold"]), "r2", float(1 - r["mse"] / r["vy"]) if r["vy"] else None),
                         (r["model"], int(r["fold"]), "rmse", float(r["mse"] ** 0.5)),
                         (r["model"], int(r["fold"]), "mae", float(r["mae"]))]
    folded.unpersist()
    return spark.createDataFrame(rows, "model string, fold int, metric string, value double")


def grouped_metrics(allp: DataFrame) -> dict:
    return M.grouped_classification_metrics(allp, ["model", "fold"])


def rank_models(summary: DataFrame, metric: str, higher_is_better: bool = True) -> DataFrame:
    """SRT-04: order by primary mean (direction aware), then smaller sd, then
    name; flags models that beat the baseline."""
    s = summary.where(F.col("metric") == metric)
    base = s.where(F.col("model") == "baseline").select(F.col("mean").alias("base_mean"))
    order = F.desc("mean") if higher_is_better else F.asc("mean")
    j = s.withColumn("__k", F.lit(1)).join(base.withColumn("__k", F.lit(1)), "__k", "left").drop("__k")
    beats = (F.col("mean") > F.col("base_mean")) if higher_is_better else (F.col("mean") < F.col("base_mean"))
    return j.withColumn("beats_baseline", F.coalesce(beats, F.lit(False))).orderBy(order, F.asc("sd"), F.asc("model"))


def vote(preds: DataFrame, key: str, model: str = "model", prediction: str = "prediction",
         weight: str | None = None) -> DataFrame:
    """MDL-12 hard voting over member predictions (long form key, model,
    prediction): weighted count per class, ties to the smallest class."""
    w = F.col(weight) if weight else F.lit(1.0)
    g = preds.groupBy(key, prediction).agg(F.sum(w).alias("votes"))
    r = g.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("votes"), F.asc(prediction))))
    return r.where(F.col("__r") == 1).select(key, F.col(prediction).alias("prediction"), "votes")


def soft_vote(preds: DataFrame, key: str, prob: str = "p1", weight: str | None = None) -> DataFrame:
    """MDL-12 soft voting / MDL-13 weighted averaging: weighted mean of the
    members' probability (or regression prediction) per key."""
    w = F.col(weight) if weight else F.lit(1.0)
    return preds.groupBy(key).agg((F.sum(w * F.col(prob)) / F.sum(w)).alias("mean"))


def stacking(df: DataFrame, features: list[str], target: str, key: str, base: list[str], k: int = 5,
             seed: int = 42) -> DataFrame:
    """MDL-14: out-of-fold base-model probabilities (binary) feed a logistic
    meta-model; returns the meta-model's OOF predictions."""
    folded = cut_lineage(assign_folds(df, key, k, seed, target)).persist()  # in as many parts as its size asks for
    codes = class_codes(folded, target)

    def fold_of(name, f):
        p = fit_predict(folded.where(F.col("fold") != f), folded.where(F.col("fold") == f), features, target, name, key=key, codes=codes)
        return p.select(key, F.lit(f).alias("fold"), F.col("label").alias("__y"), F.lit(name).alias("model"), "p1")

    with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
        parts = list(pool.map(lambda job: fold_of(*job), [(name, f) for name in base for f in range(k)]))
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    wide = long.groupBy(key, "fold").agg(F.max("__y").cast("string").alias("__t"), *[F.max(F.when(F.col("model") == n, F.col("p1"))).alias(f"p_{n}") for n in base])
    meta = cut_lineage(wide)  # else every meta fit runs all base models again
    folded.unpersist()
    res = None
    for f in range(k):
        o = fit_predict(meta.where(F.col("fold") != f), meta.where(F.col("fold") == f), [f"p_{n}" for n in base], "__t", "logistic", key=key)
        res = o if res is None else res.unionByName(o)
    return res


def bagging(train: DataFrame, test: DataFrame, features: list[str], target: str, name: str = "decision_tree",
            n: int = 10, key: str | None = None, seed: int = 42) -> DataFrame:
    """MDL-15: n bootstrap copies, majority vote. A row's number of copies is a Poisson(1)
    draw from its key and the seed, so a recomputed partition draws the same rows."""
    if key is None:
        raise ValueError("bagging needs a row key")
    chances = [math.exp(-1) * sum(1 / math.factorial(j) for j in range(i + 1)) for i in range(10)]
    train, test = cut_lineage(train), cut_lineage(test)  # read once a copy
    codes = class_codes(train, target)

    def one(i):
        copies = sum((uniform(seed + i, q(key)) >= c).cast("int") for c in chances)
        boot = train.withColumn("__copy", F.explode(F.sequence(F.lit(0), copies))).where("__copy > 0").drop("__copy")
        return fit_predict(boot, test, features, target, name, key=key, codes=codes).select(key, F.lit(i).alias("model"), "prediction")

    with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
        parts = list(pool.map(one, range(n)))
    preds = parts[0]
    for p in parts[1:]:
        preds = preds.unionByName(p)
    return vote(preds.where(F.col("prediction").isNotNull()), key)


def unknown_labels(new: DataFrame, train: DataFrame, col: str) -> DataFrame:
    """SET-05: categories present in new rows but never seen in training."""
    a = new.select(q(col).cast("string").alias("value")).where(F.col("value").isNotNull()).distinct()
    b = train.select(q(col).cast("string").alias("value")).distinct()
    return a.join(b, "value", "left_anti")
