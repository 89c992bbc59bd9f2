"""DBSCAN, silhouettes and tree SHAP against brute force; model tables with clashing names."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F


def brute_dbscan(x, eps, min_samples):
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)) <= eps
    core, out, c = near.sum(axis=1) >= min_samples, np.full(len(x), -1), 0
    for i in np.flatnonzero(core):
        if out[i] < 0:
            out[i], todo = c, [i]
            while todo:
                for m in np.flatnonzero(near[todo.pop()] & core & (out < 0)):
                    out[m] = c
                    todo.append(m)
            c += 1
    for i in np.flatnonzero(~core):
        labels = out[near[i] & core]
        out[i] = labels.min() if len(labels) else -1
    return out, core


@pytest.mark.parametrize("dims, eps, chunk", [(2, 0.4, 16), (5, 1.6, 64), (1, 0.05, 2048)])
def test_dbscan_is_the_brute_force_one(spark, dims, eps, chunk):
    from quarry.operators.density import dbscan

    rng = np.random.default_rng(dims)
    x = np.concatenate([rng.normal(0, 0.3, (150, dims)), rng.normal(3, 0.5, (80, dims)), rng.uniform(-4, 8, (50, dims)),
                        np.zeros((60, dims)), rng.normal(-3, 0.01, (90, dims))]).round(3)  # one point many times, one hot cell
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [None] * dims), (902, [float("nan")] * dims)]
    df = spark.createDataFrame(rows, "k long, x array<double>").repartition(5).withColumn("cluster", F.lit("clash"))
    got = {r["k"]: (r["cluster"], r["kind"]) for r in dbscan(df, "k", ["x"], eps, 6, chunk).collect()}
    labels, core = brute_dbscan(x, eps, 6)
    want = {i: (int(c), "core" if k else "border" if c >= 0 else "noise") for i, (c, k) in enumerate(zip(labels, core))}
    assert got == want | {900: (None, None), 901: (None, None), 902: (None, None)}
    assert dbscan(df.where("k > 899"), "k", ["x"], eps).count() == 3 and dbscan(df.where("k < 0"), "k", ["x"], eps).count() == 0


def test_components_and_numbers(spark):
    from quarry.operators.graph import connected_components, join_groups, numbered

    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(300, 301), (301, 300), (302, 302)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {300: 300, 301: 300}
    rows = spark.createDataFrame([(f"w{i % 7}", i) for i in range(200)], "w string, i long").repartition(6)
    places = numbered(rows, ["w", "i"], "place").orderBy("place").collect()
    assert [r["place"] for r in places] == list(range(200)) and [(r["w"], r["i"]) for r in places] == sorted((f"w{i % 7}", i) for i in range(200))
    groups = rows.groupBy("w").agg(F.count("*").alias("n"))
    assert join_groups(rows, groups, "w", "n").count() == 200


def test_silhouettes(spark):
    from quarry.operators.density import silhouette_bars, silhouette_rows

    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 1, (40, 3)), rng.normal(2, 1, (30, 3)), [[9.0, 9.0, 9.0]]])
    c = np.array([0] * 40 + [1] * 30 + [2])
    df = spark.createDataFrame([(i, *map(float, v), int(k)) for i, (v, k) in enumerate(zip(x, c))] + [(200, 1.0, 1.0, 1.0, -1), (201, None, 1.0, 1.0, 0), (202, 1.0, 1.0, 1.0, None)],
                               "k long, a double, b double, d double, cluster int").repartition(3)
    scored = silhouette_rows(df, "k", ["a", "b", "d"])
    got = {r["k"]: r["silhouette"] for r in scored.collect()}
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    for i in range(len(x)):
        own = (c == c[i]) & (np.arange(len(x)) != i)
        a, b = (far[i, own].mean() if own.any() else None), min(far[i, c == o].mean() for o in set(c) - {c[i]})
        assert got[i] == pytest.approx(0.0 if a is None else (b - a) / max(a, b))
    assert set(got) == set(range(len(x)))
    bars = silhouette_bars(scored, shown=7).where("cluster = 0").orderBy("place").collect()
    assert [r["place"] for r in bars] == np.unique(np.linspace(0, 39, 7).round().astype(int)).tolist() and bars[0]["size"] == 40
    assert {r["silhouette"] for r in silhouette_rows(df.where("cluster = 0"), "k", ["a", "b", "d"]).collect()} == {None}
    assert silhouette_rows(df.limit(0), "k", ["a", "b", "d"]).count() == 0


def test_clusters_keep_rows_with_gaps(spark):
    from quarry.operators.cluster import fit_clusters, silhouette

    df = spark.createDataFrame([(i, float(i % 2) * 9, float(i % 5)) for i in range(40)] + [(99, None, 1.0)], "k long, a double, b double")
    _, out = fit_clusters(df, ["a", "b"], "kmeans", 2)
    assert out.count() == 41 and out.where("k = 99").first()["cluster"] is None and out.where("cluster is not null").count() == 40
    assert silhouette(out, ["a", "b"]) > 0.5


FEATURES = ["a", "b", "c", "d"]


def shap_table(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(250, 4)).round(2)
    rows = [(i, *map(float, v), float(v[0] + v[1] * v[2] > 0), float(2 * v[0] + v[1] * v[2]), float(i % 3)) for i, v in enumerate(x)]
    return x, spark.createDataFrame(rows, "k long, a double, b double, c double, d double, two double, y double, three double")


@pytest.mark.parametrize("family", ["tree2", "tree3", "forest2", "boosted2", "tree", "forest", "boosted"])
def test_tree_shap_adds_up_and_equals_all_subsets(spark, family):
    from pyspark.ml import classification as C
    from pyspark.ml import regression as R

    from quarry.operators.treeshap import model_leaves, tree_shap

    x, df = shap_table(spark)
    table = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(df)
    model = {"tree2": C.DecisionTreeClassifier(maxDepth=4, labelCol="two"), "tree3": C.DecisionTreeClassifier(maxDepth=4, labelCol="three"),
             "forest2": C.RandomForestClassifier(numTrees=4, maxDepth=4, seed=1, labelCol="two"), "boosted2": C.GBTClassifier(maxIter=3, maxDepth=3, seed=1, labelCol="two"),
             "tree": R.DecisionTreeRegressor(maxDepth=5, labelCol="y"), "forest": R.RandomForestRegressor(numTrees=3, maxDepth=4, seed=1, labelCol="y"),
             "boosted": R.GBTRegressor(maxIter=3, seed=1, labelCol="y")}[family].fit(table)
    got = sorted(tree_shap(model, df.withColumn("phi", F.lit(1)).union(df.limit(1).withColumn("k", F.lit(-1).cast("long")).withColumn("a", F.lit(None).cast("double")).withColumn("phi", F.lit(1))), FEATURES, "k").collect())
    assert got[0]["k"] == -1 and got[0]["phi"] is None and got[0]["base"] is None
    got = got[1:]
    scored = {r["k"]: r for r in model.transform(table).collect()}
    leaves = model_leaves(model)

    def expected(row, known):
        total = 0.0
        for leaf in leaves:
            passes = leaf.passes(row[None])[0]
            total += leaf.value * np.prod([passes[i] if f in known else leaf.z[i] for i, f in enumerate(leaf.features)])
        return total

    for r in got:
        out = scored[r["k"]]
        truth = out["rawPrediction"][1] if family == "boosted2" else out["probability"][1] if family[-1] in "23" else out["prediction"]
        assert r["output"] == pytest.approx(truth, abs=1e-9) and r["base"] + sum(r["phi"]) == pytest.approx(r["output"], abs=1e-9)
    for r in got[:6]:
        for j in range(4):
            others = [f for f in range(4) if f != j]
            phi = sum(factorial(n) * factorial(3 - n) / 24 * (expected(x[r["k"]], {*s, j}) - expected(x[r["k"]], set(s))) for n in range(4) for s in combinations(others, n))
            assert r["phi"][j] == pytest.approx(phi, abs=1e-9)


def test_tables_with_a_column_named_label(spark):
    from quarry.operators.explain import fit_model, permutation_importance
    from quarry.operators.models import cross_validate, fit_predict, stacking

    rows = [(i, float(i % 7), float(i % 11), "yes" if (i % 7) + (i % 11) > 7 else "no", "x", 1.0) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, a double, b double, target string, label string, prediction double")
    for name in ("logistic", "decision_tree", "baseline"):
        out = fit_predict(df, df, ["a", "b"], "target", name, key="k")
        assert out.count() == 200 and out.columns[:3] == ["k", "label", "prediction"]
    assert fit_predict(df, df, ["a", "b"], "target", "logistic", key="k", params={"class_weight": "balanced"}).count() == 200
    assert stacking(df, ["a", "b"], "target", "k", ["logistic", "naive_bayes"], 3).count() == 200
    model, classes = fit_model(df, ["a", "b"], "target", "decision_tree")
    drops = {r["feature"]: r["mean_drop"] for r in permutation_importance(model, df, ["a", "b"], "target", "k", classes, repeats=2).collect()}
    assert drops["a"] > 0.05 and drops["b"] > 0.05
    cv = cross_validate(df, ["a", "b"], "target", ["baseline", "logistic", "no_such_model"], "k", 3).collect()
    assert {r["metric"] for r in cv if r["model"] == "no_such_model"} == {"error:ValueError"}
    assert min(r["value"] for r in cv if r["model"] == "logistic" and r["metric"] == "accuracy") > 0.9


def test_classes_are_numbered_in_order_however_many(spark):
    from quarry.operators.models import class_codes

    df = spark.range(1500).selectExpr("cast(id as string) as t")
    for table, n in ((df, 1500), (df.where("t < 13"), 13), (df.limit(0), 0)):
        got = class_codes(table, "t").orderBy("label").collect()
        assert [(r["value"], r["label"]) for r in got] == [(v, float(i)) for i, v in enumerate(sorted(str(k) for k in range(n)))]


@pytest.mark.parametrize("bridge, chunk", [(0.0, 2048), (0.999, 16), (1.001, 16)])
def test_dbscan_with_crowded_cells_is_the_brute_force_one(spark, bridge, chunk):
    """Rings and a pair of crowds that touch, or not, by two inner points alone; most points lie in dense fine cells."""
    from quarry.operators.density import dbscan

    rng = np.random.default_rng(4)
    angle = rng.uniform(0, 2 * np.pi, 500)
    rings = np.concatenate([np.stack([np.cos(angle) * r, np.sin(angle) * r], 1) for r in (3.0, 4.4)])
    crowds = np.concatenate([rng.uniform(0, 0.6, (200, 2)) * [1, 3] + [20, 0], rng.uniform(0, 0.6, (200, 2)) * [1, 3] + [21.55, 0], [[20.6, 0.9], [20.6 + bridge, 0.9]]])
    # two crowds, one fine cell each, linked by a point that is no outermost one
    apart = np.array([[0.6, 0.01], [0.6, 0.69], [0.1, 0.01], [0.1, 0.69], [0.3, 0.3], [1.58 - max(bridge, 1.001 - bridge), 0.35],
                      [1.57, 0.35], [2.0, 0.1], [2.0, 0.6], [1.9, 0.35], [2.1, 0.35]]) + [0, -20 * 2 ** -0.5 * (1 - 1e-6)]
    x = np.concatenate([rings, crowds, rng.uniform(-6, 25, (60, 2)), apart])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, x array<double>").repartition(5)
    got = {r["k"]: (r["cluster"], r["kind"]) for r in dbscan(df, "k", ["x"], 1.0, 5, chunk).collect()}
    labels, core = brute_dbscan(x, 1.0, 5)
    assert got == {i: (int(c), "core" if k else "border" if c >= 0 else "noise") for i, (c, k) in enumerate(zip(labels, core))}


def test_dots_are_ranked_among_all_rows_and_fits_have_bounded_parts(spark, monkeypatch):
    from quarry.operators import explain as X
    from quarry.operators.ranks import percent_rank_rows
    from quarry.operators.treeshap import shap_dots

    df = spark.createDataFrame([(i, float(i * 7 % 40), float(i % 3), None if i == 5 else 1.0) for i in range(90)] + [(5, 9.5, 2.0, 2.0)], "k long, a double, b double, c double").repartition(3)
    shap = df.select("k", F.array(F.col("a") / 9, F.col("b"), F.col("a") * 0).alias("phi"))
    reads = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda v: reads.add(1) or v, "double").asNondeterministic()
    got = shap_dots(shap.withColumn("phi", F.transform("phi", lambda v: v)), df.withColumn("c", seen("c")), ["a", "b", "c"], "k", rows=100)
    rows = {(r["feature"], r["k"], r["phi"], r["value"], r["position"]) for r in got.collect()}
    assert reads.value == 91  # the table is worked out once, not once a feature
    want = set()
    for i, f in enumerate(["a", "b", "c"]):
        ranked = percent_rank_rows(df.select("k", F.col(f).alias("value")), "value", out="position")
        want |= {(f, r["k"], r["phi"][i], r["value"], r["position"]) for r in shap.join(ranked, "k").collect()}
    assert rows == want
    monkeypatch.setattr(X, "FIT_ROWS", 10)
    spread = X.fit_parts(spark.range(0, 95, 1, 2))
    assert spread.count() == 95 and max(r["count"] for r in spread.groupBy(F.spark_partition_id()).count().collect()) <= 12
