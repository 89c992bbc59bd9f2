"""Model helpers where rows or classes used to get lost."""

import numpy as np
from pyspark.sql import functions as F


def test_many_classes_and_null_features_keep_every_row(spark):
    from quarry.operators.models import fit_predict

    train = spark.range(2600).select("id", (F.col("id") % 1300).cast("string").alias("y"), (F.col("id") % 1300).cast("double").alias("x"))
    test = train.withColumn("x", F.when(F.col("id") % 13 > 0, F.col("x")))
    out = fit_predict(train, test, ["x"], "y", "baseline", key="id")
    assert out.count() == 2600 and out.where("label is null").count() == 0
    few = spark.range(60).select("id", (F.col("id") % 3).cast("string").alias("y"), (F.col("id") % 3 + F.rand(1)).alias("x"))
    gaps = few.withColumn("x", F.when(F.col("id") >= 7, F.col("x")))
    out = fit_predict(few, gaps, ["x"], "y", "decision_tree", key="id")
    assert out.count() == 60 and out.where("prediction is null").count() == 7


def test_missing_predictions_count_as_wrong(spark):
    from quarry.operators.metrics import classification_metrics, grouped_classification_metrics

    df = spark.createDataFrame([("m", "a", "a"), ("m", "a", None), ("m", "b", "b")], "model string, label string, prediction string")
    r = classification_metrics(df, "label", "prediction").first()
    assert r["n"] == 3 and abs(r["accuracy"] - 2 / 3) < 1e-12
    assert abs(grouped_classification_metrics(df, ["model"])[("m",)]["accuracy"] - 2 / 3) < 1e-12


def test_ridge_matches_the_closed_form(spark):
    from quarry.operators.models import fit_predict

    rng = np.random.default_rng(0)
    x, y = rng.normal(size=40), None
    y = 3 * x + rng.normal(size=40)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "id long, x double, y double")
    got = fit_predict(df, df, ["x"], "y", "ridge", "regression", {"alpha": 5.0}, "id").orderBy("id").collect()
    slope = ((x - x.mean()) * (y - y.mean())).sum() / (((x - x.mean()) ** 2).sum() + 5.0)
    want = y.mean() + slope * (x - x.mean())
    assert np.allclose([r["prediction"] for r in got], want, atol=1e-3)


def test_chained_imputation_beats_one_regression(spark):
    from quarry.operators.advanced import apply_iterative, iterative_impute

    rng = np.random.default_rng(1)
    z = rng.normal(size=400)
    data = np.stack([z + 0.4 * rng.normal(size=400) for _ in range(4)], axis=1)
    rows = [[float(v) for v in r] for r in data]
    for i in range(0, 400, 4):
        rows[i][0] = rows[i][1] = None
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, a double, b double, c double, d double")
    state = iterative_impute(df, ["a", "b", "c", "d"])
    out = np.array([(r["a"], r["b"]) for r in apply_iterative(state, df).orderBy("id").collect()])
    gap = np.arange(0, 400, 4)
    known = np.setdiff1d(np.arange(400), gap)
    design = lambda i: np.column_stack([np.ones(len(i)), data[i, 2:]])
    beta = np.linalg.lstsq(design(known), data[known, 0], rcond=None)[0]
    plain = np.sqrt(((design(gap) @ beta - data[gap, 0]) ** 2).mean())
    assert np.sqrt(((out[gap, 0] - data[gap, 0]) ** 2).mean()) < 1.1 * plain


def test_smote_with_duplicates_reaches_the_largest_class(spark):
    from quarry.operators.knn import smote

    rows = [(i, float(i % 7), float(i % 5), "big") for i in range(60)] + [(100 + i, 1.0, 1.0, "dup") for i in range(10)] + [(200 + i, float(i // 2), 2.0, "pair") for i in range(12)]
    out = smote(spark.createDataFrame(rows, "id long, x double, y double, label string"), ["x", "y"], "label", "id")
    assert {r["label"]: r["count"] for r in out.groupBy("label").count().collect()} == {"big": 60, "dup": 60, "pair": 60}


def test_rfe_and_ols_on_hard_inputs(spark):
    from quarry.operators.advanced import rfe
    from quarry.operators.stats import ols

    df = spark.range(300).select((F.col("id") % 3).alias("y"), (F.col("id") % 3 + F.rand(1) * 0.1).alias("good"), F.rand(2).alias("noise"))
    kept = {r["feature"] for r in rfe(df, ["good", "noise"], "y", 1).where("selected").collect()}
    assert kept == {"good"}
    far = spark.range(200).select((1e8 + F.randn(3)).alias("x"), F.randn(4).alias("e")).withColumn("y", F.col("x") * 2 + F.col("e") * 0.01)
    coef, _ = ols(far, "y", ["x"])
    assert abs(coef.where("term = 'x'").first()["estimate"] - 2) < 0.01


def test_entries_run_the_operators_own_rounds(spark, monkeypatch):
    import inspect
    from unittest.mock import MagicMock

    from quarry.operators import advanced, explain, models, prep
    from quarry.plans import q_models as Q

    seen = {}
    for module, name, out in ((models, "bagging", None), (models, "cross_validate", None), (advanced, "adaboost", ([], [])), (explain, "permutation_importance", None)):
        def call(*a, _sig=inspect.signature(getattr(module, name)), _name=name, _out=out, **k):
            bound = _sig.bind(*a, **k)
            bound.apply_defaults()
            seen[_name] = bound.arguments
            return _out
        monkeypatch.setattr(module, name, call)
    monkeypatch.setattr(advanced, "adaboost_predict", MagicMock())
    monkeypatch.setattr(explain, "fit_model", lambda *a: (None, []))
    monkeypatch.setattr(prep, "split", MagicMock())
    for name in ("order_features", "rounded", "M"):
        monkeypatch.setattr(Q, name, MagicMock())
    for entry in (Q.q_bag, Q.q_ada, Q.q_perm, Q.q_boost):
        entry(spark, "nowhere")
    assert (seen["bagging"]["n"], seen["adaboost"]["n_estimators"], seen["permutation_importance"]["repeats"], seen["cross_validate"]["k"]) == (10, 50, 5, 5)


def test_splits_and_labels_keep_rows_spread(spark):
    """Two classes must not leave the whole table in two tasks."""
    from pyspark.sql import functions as F

    from quarry.operators.models import _labelled, class_codes
    from quarry.operators.prep import split

    df = spark.range(0, 4000, 1, 4).select("id", F.when(F.col("id") % 4 == 0, "yes").otherwise("no").alias("y"))
    # a large table by Spark's estimate, most of whose partitions by class are empty: joins by class stay sort-merge joins
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "24", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    was = {name: spark.conf.get(name) for name in conf}
    for name, value in conf.items():
        spark.conf.set(name, value)
    try:
        s = split(df, "id", 0.2, 42, "y")
        filled = lambda d: d.groupBy(F.spark_partition_id()).count().count()
        assert filled(s) > 4 and filled(split(df, "id", 0.2, 42)) > 4
        assert filled(_labelled(s, "y", "classification", class_codes(s, "y"))) > 4
    finally:
        for name, value in was.items():
            spark.conf.set(name, value)
    assert {tuple(r) for r in s.groupBy("y", "__split__").count().collect()} == {
        ("yes", "test", 200), ("yes", "train", 800), ("no", "test", 600), ("no", "train", 2400)}


def test_boosting_does_not_repeat_earlier_rounds(spark):
    """Each round reads the weights stored by the round before."""
    from pyspark.sql import functions as F

    from quarry.operators.advanced import adaboost, adaboost_predict

    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        seen.add(1)
        return float(x)

    rows = spark.range(0, 200, 1, 2).select("id", (F.col("id") % 17).alias("a"), F.when((F.col("id") % 17 > 8) != (F.col("id") % 23 > 20), "u").otherwise("v").alias("y"))
    ens, classes = adaboost(rows.withColumn("x", counted("a")), ["x"], "y", 6)
    assert len(ens) == 6 and seen.value <= 800  # the table is computed for its classes and once for all rounds
    out = adaboost_predict(ens, classes, rows.withColumn("x", F.col("a").cast("double")), ["x"])
    assert out.where(F.col("prediction") == F.col("y")).count() > 150


def test_an_export_in_several_files_reads_as_one(spark, sf, monkeypatch):
    """Each file has its note and header; no file holds the whole table."""
    from quarry.plans import q_io

    want = sorted(map(tuple, q_io.q_dimensions(spark, sf).collect()), key=str)
    monkeypatch.setattr(q_io, "EXPORT_ROWS", 300)
    got = q_io.q_dimensions(spark, sf)
    assert len(got.inputFiles()) > 3 and sorted(map(tuple, got.collect()), key=str) == want and len(want) > 1000


def test_rows_are_scored_once_by_the_isolation_forest(spark, monkeypatch):
    from quarry.operators import advanced

    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, float(rng.normal()), float(rng.normal())) for i in range(300)] + [(300, 50.0, 50.0)], "k long, a double, b double")
    seen, own = spark.sparkContext.accumulator(0), advanced.isolation_scores

    def counted(*a, **b):
        def count(batches):
            for x in batches:
                seen.add(len(x))
                yield x
        return own(*a, **b).mapInPandas(count, "k long, anomaly_score double")

    monkeypatch.setattr(advanced, "isolation_scores", counted)
    kept = {r["k"] for r in advanced.remove_isolated(rows, ["a", "b"], "k", 0.05).collect()}
    assert seen.value == 301 and 300 not in kept and len(kept) == 286


def test_ranks_by_md5_look_for_no_bounds(spark, monkeypatch):
    from quarry.operators import ranks
    from quarry.operators.prep import class_ranks

    monkeypatch.setattr(ranks, "_bucket_bounds", None)
    rows = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(200)], "k long, c string")
    for group in ("a", "b"):
        found = sorted((r["__u"], r["__rank"]) for r in class_ranks(rows, "k", 42, ["c"]).where(F.col("c") == group).collect())
        assert [r for _, r in found] == list(range(1, 101))
