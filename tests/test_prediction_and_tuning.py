"""Stored chains, result tables, assembled vectors, nan-Euclidean imputation, search, early stopping, presets, multiclass curves."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

CHAIN = [{"op": "trim_whitespace", "column": "kind"}, {"op": "retype", "column": "size", "to": "number"}, {"op": "drop_duplicates"}]
PLAN = {"size": [{"op": "impute", "method": "median"}, {"op": "scale", "method": "standard"}], "shape": [{"op": "encode", "method": "onehot"}]}


def raw_table(spark):
    rows = [(i, f" {'big' if i % 10 > 4 else 'small'}", str(i % 10) if i % 13 else None, "round" if i % 3 else "flat", float(i % 4)) for i in range(300)]
    rows += [(900, "never seen", "3", "round", 1.0), (901, None, "4", "flat", 1.0), (902, "  ", "4", "flat", 1.0), (903, "big", "9", "other", None), rows[0]]
    return spark.createDataFrame(rows, "id long, kind string, size string, shape string, extra double").withColumn("prediction", F.lit("own")).withColumn("features", F.lit("own"))


def test_chain_saved_and_loaded(spark, tmp_path):
    from quarry.operators.predictor import Predictor

    raw = raw_table(spark).drop("prediction", "features")
    train = raw.where("id < 300")
    fitted = Predictor.fit(train, "kind", ["size", "shape", "extra"], "logistic", clean_ops=CHAIN, plan=PLAN, key="id", params={"reg": 0.001})
    path = f"file:{tmp_path}/m"
    fitted.save(spark, path)
    with pytest.raises(ValueError, match="exists"):
        fitted.save(spark, path)
    loaded = Predictor.load(spark.newSession(), path)
    out = loaded.predict(raw)
    assert out.columns == [*raw.columns, "prediction", "probability big", "probability small", "scored", "note", "actual"] and out.count() == raw.count()
    first, again = ({r["id"]: (r["prediction"], r["probability big"], r["scored"], r["note"]) for r in p.predict(raw).collect()} for p in (fitted, loaded))
    assert first == again
    assert first[900][2:] == (False, "a class the model never saw - not scored") and first[901][2:] == (False, None) and first[902][2:] == (False, None)
    assert first[903][0] is None and first[903][2] is False  # a gap that the plan does not fill
    assert loaded.score(out)["accuracy"] > 0.9
    assert loaded.predict(raw.drop("kind")).columns[-1] == "probability small"
    with pytest.raises(ValueError, match="missing columns"):
        loaded.predict(raw.drop("size"))
    wrong = loaded.test_rows(out, ["id"], mistakes_only=True).collect()
    assert all(r["actual"] != r["prediction"] and 0.5 <= r["confidence"] <= 1 for r in wrong)
    page = loaded.test_rows(out, ["id"], offset=5, limit=7).collect()
    assert [r["id"] for r in page] == sorted(r["id"] for r in out.where("scored").collect())[5:12]


def test_load_refuses_another_version(spark, tmp_path):
    import json

    from quarry.operators.predictor import Predictor

    raw = raw_table(spark).drop("prediction", "features")
    fitted = Predictor.fit(raw.where("id < 300"), "extra", ["size"], "linear", task="regression", clean_ops=CHAIN, plan=PLAN, key="id")
    fitted.save(spark, f"file:{tmp_path}/m")
    assert fitted.predict(raw).where("scored").count() == 304
    doc = json.loads(spark.read.text(f"file:{tmp_path}/m/manifest").first()[0])
    for change in ({"spark_version": "3.0.0"}, {"format": 99}):
        other = f"file:{tmp_path}/{uuid.uuid4().hex}"
        spark.createDataFrame([(json.dumps(doc | change),)], "value string").write.text(f"{other}/manifest")
        with pytest.raises(ValueError, match="the model's"):
            Predictor.load(spark, other)


def test_features_must_become_numbers(spark):
    from quarry.operators.predictor import Predictor

    with pytest.raises(ValueError, match="encode"):
        Predictor.fit(raw_table(spark), "kind", ["shape"], "logistic")


def test_result_store_replaces_a_run(spark, tmp_path):
    from quarry.operators.predictor import ResultStore, write_assignments

    store = ResultStore(spark, f"file:{tmp_path}/r")
    store.put("a", "t", spark.range(5).withColumn("l", F.array(F.lit("x"), F.lit("y"))))
    store.put("b", "t", spark.range(2).withColumn("l", F.array(F.lit("z"))))
    store.put("a", "t", spark.range(3).withColumn("l", F.array(F.lit("x"), F.lit("y"))))
    assert sorted((r["run"], r["id"], r["l"]) for r in store.get("t").collect()) == [("a", i, "x; y") for i in range(3)] + [("b", i, "z") for i in range(2)]
    with pytest.raises(ValueError, match="without a cluster"):
        write_assignments(spark.createDataFrame([(1, None)], "k int, cluster int"), f"file:{tmp_path}/a")


def test_assembled_vectors(spark):
    from quarry.operators.assemble import TextBlock, assemble, stored_entries

    df = spark.createDataFrame([(1, 2.0, 0, "the cat sat"), (2, None, 1, "dog dog"), (3, 0.0, 3, None), (4, 1.0, 2, "cat dog unseen the the")], "k int, a double, b int, t string")
    block = TextBlock(df.where("k < 3"), "k", "t", n_max=1)
    assert [r["term"] for r in block.terms.orderBy("place").collect()] == ["cat", "dog", "sat", "the"]
    got = {r["k"]: r for r in stored_entries(assemble(df.withColumn("features", F.lit(1)), "k", ["a", "b"], [block])).collect()}
    assert got[2]["indices"] is None and got[3]["indices"] == [1] and got[3]["values"] == [3.0] and got[1]["size"] == 6
    assert got[4]["indices"] == [0, 1, 2, 3, 5] and sum(v * v for v in got[4]["values"][2:]) == pytest.approx(1)
    for r in assemble(df, "k", ["a", "b"], [block]).where("features is not null").collect():
        assert r["features"].numNonzeros() == len(got[r["k"]]["indices"]) and r["features"].size == 6
    with pytest.raises(ValueError, match="encode it first"):
        assemble(df, "k", ["t"], [])


def test_terms_of_marked_rows_are_counted_once(spark):
    from quarry.operators.assemble import TextBlock, assemble, stored_entries
    from quarry.operators.prep import word_ngrams

    made = []

    def ngrams(*a, **k):
        made.append(1)
        return word_ngrams(*a, **k)

    df = spark.createDataFrame([(1, 2.0, True, "the cat sat"), (2, 1.0, True, "dog dog"), (3, 0.0, False, None), (4, 1.0, False, "cat dog unseen the the")], "k int, a double, m boolean, t string")
    block = TextBlock(df, "k", "t", ngrams, taught="m", n_max=1)
    plain = TextBlock(df.where("m"), "k", "t", n_max=1)
    rows = lambda b: sorted((r["k"], tuple(r["indices"]), tuple(round(v, 12) for v in r["values"])) for r in stored_entries(assemble(df, "k", ["a"], [b], keep=["k"])).collect())
    assert block.size == 4 and rows(block) == rows(plain) and made == [1]
    assert assemble(df, "k", ["a"], [block], keep=["k"]).columns == ["k", "features"]
    assert sorted(rows(block))[3][1] == (0, 1, 2, 4)  # rows given to be assembled, not those of the training
    part = df.where("k = 4")  # other rows than the marked ones: counted anew
    assert assemble(part, "k", ["a"], [block], keep=["k"]).count() == 1 and made == [1, 1]


def test_words_are_cut_once_and_pairs_are_right(spark):
    from quarry.operators.prep import word_ngrams

    df = spark.createDataFrame([(1, "Ab cd  ab-x ef"), (2, "gh"), (3, ""), (4, None)], "d int, t string")
    got = word_ngrams(df, "d", "t", 3)
    assert sorted((r["doc"], r["term"]) for r in got.collect()) == sorted([(1, w) for w in ["ab", "cd", "ab", "ef", "ab cd", "cd ab", "ab ef", "ab cd ab", "cd ab ef"]] + [(2, "gh")])
    plan = word_ngrams(df, "d", "t", 1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_fitting_works_the_rows_out_once(spark):
    from quarry.operators.prep import fit_prep, transform

    seen = spark.sparkContext.accumulator(0)

    def count(x):
        seen.add(1)
        return x

    rows = spark.createDataFrame([(i, float(i % 7) if i % 5 else None) for i in range(40)], "k int, x double")
    train = rows.withColumn("x", F.udf(count, "double").asNondeterministic()("x"))
    state = fit_prep(train, {"x": [{"op": "impute", "strategy": "median"}, {"op": "scale"}]}, "k")
    assert seen.value == 40 and transform(state, rows).count() == 40


def test_short_words_count_once(spark):
    from quarry.operators.prep import char_wb_ngrams

    got = sorted(r["term"] for r in char_wb_ngrams(spark.createDataFrame([(1, "a bc")], "d int, t string"), "d", "t").collect())
    assert got == sorted([" a ", " bc", "bc ", " bc "])


def test_knn_block_is_the_brute_force_one(spark):
    from quarry.operators.knn import knn_impute_block

    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 4)).round(2)
    x[rng.random(x.shape) < 0.2] = np.nan
    x[5] = np.nan
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "k long, a double, b double, c double, d double")
    train = df.where("k % 3 <> 0")
    got = {r["k"]: r for r in knn_impute_block(train, df, ["a", "b", "c", "d"], "k", 3).collect()}
    means = np.nanmean(x[[i for i in range(90) if i % 3]], axis=0)
    for i in range(90):
        for j, name in enumerate("abcd"):
            want = x[i, j]
            if np.isnan(want):
                near = []
                for t in range(90):
                    both = ~np.isnan(x[i]) & ~np.isnan(x[t])
                    if t % 3 and not np.isnan(x[t, j]) and both.any():
                        near.append((round(np.sqrt(4 / both.sum() * ((x[i] - x[t])[both] ** 2).sum()), 9), t))
                want = np.mean([x[t, j] for _, t in sorted(near)[:3]]) if near else means[j]
            assert got[i][name] == pytest.approx(want, abs=1e-9), (i, name)


def test_candidates_are_seeded_and_bounded():
    from quarry.operators.tuning import RANGES, candidates, spread

    space = {"C": RANGES["C"], "max_depth": RANGES["max_depth"], "kind": ["a", "b"]}
    assert candidates(space, n=30, seed=1) == candidates(space, n=30, seed=1) != candidates(space, n=30, seed=2)
    assert all(1e-3 <= c["C"] <= 1e3 and 2 <= c["max_depth"] <= 20 and isinstance(c["max_depth"], int) for c in candidates(space, n=200))
    assert np.median([c["C"] for c in candidates({"C": RANGES["C"]}, n=400)]) < 20  # logarithmic
    assert len(candidates({"max_depth": (2, 5, False, True)}, n=50)) == 4
    assert len(candidates(space, "grid")) == 3 * 3 * 2 and spread(*RANGES["C"], 3) == [0.001, 1.0, 1000.0]
    with pytest.raises(ValueError):
        candidates({k: list(range(30)) for k in "ab"}, "grid")


def learnable(spark, n=240):
    rng = np.random.default_rng(8)
    rows = [(i, *map(float, v), "yes" if v[0] + v[1] > 0 else "no") for i, v in enumerate(rng.normal(size=(n, 3)).round(3))]
    return spark.createDataFrame(rows, "k long, a double, b double, c double, y string")


def test_one_aggregate_needs_no_stored_copy(spark, monkeypatch):
    from quarry.operators import prep

    stored, own = [], prep.cut_lineage
    monkeypatch.setattr(prep, "cut_lineage", lambda df: stored.append(1) or own(df))
    rows = spark.createDataFrame([(i, float(i)) for i in range(5)], "k int, x double")
    state = prep.fit_prep(rows, {"x": [{"op": "scale"}]}, "k")
    assert not stored and state["x"][0][1] == {"center": 2.0, "scale": 2.0 ** 0.5}


def test_search_and_validation_curve(spark):
    from quarry.operators.prep import split
    from quarry.operators.tuning import search, validation_curve

    d = split(learnable(spark), "k", 0.25, 42, "y")
    train, test = (d.where(F.col("__split__") == p).drop("__split__") for p in ("train", "test"))
    got = search(train, test, ["a", "b", "c"], "y", "decision_tree", "k", n=3, space={"max_depth": [1, 2, 6]}, k=3).collect()
    best = [r for r in got if r["best"]]
    assert len(got) == 3 and len(best) == 1 and best[0]["mean"] == max(r["mean"] for r in got) and best[0]["test_score"] > 0.7
    assert all(r["test_score"] is None for r in got if not r["best"])
    curve = validation_curve(train, ["a", "b", "c"], "y", "decision_tree", "max_depth", "k", values=[1, 6], k=3).orderBy("value").collect()
    assert curve[1]["train_mean"] > curve[0]["train_mean"] and curve[1]["train_mean"] >= curve[1]["val_mean"]


@pytest.mark.parametrize("task", ["classification", "regression"])
def test_one_tree_a_fold_answers_for_all_depths(spark, monkeypatch, task):
    from quarry.operators import tuning

    d = learnable(spark).withColumn("y", F.hash("k", "y") % 7 if task == "regression" else F.col("y")).withColumn("a", F.when(F.col("k") % 11 > 0, F.col("a")))
    sets, fits, own = [{"max_depth": n} for n in (3, 1, 6, 2)], [], tuning.fit_predict
    monkeypatch.setattr(tuning, "fit_predict", lambda *a, **b: fits.append(a[6]) or own(*a, **b))
    got = tuning._fold_scores(d, ["a", "b", "c"], "y", "decision_tree", sets, "k", 3, task, 42, with_train=True)
    assert fits == [{"max_depth": 6}] * 3  # one fit a fold
    alone = [tuning._fold_scores(d, ["a", "b", "c"], "y", "decision_tree", [{**s, "own": 1}], "k", 3, task, 42, with_train=True) for s in sets]
    assert len(got) == 24 and all(abs(got[i, f, part] - alone[i][0, f, part]) < 1e-12 for i, f, part in got)


def test_early_stop_on_noise(spark):
    from quarry.operators.tuning import boosted

    rng = np.random.default_rng(1)
    rows = [(i, float(rng.normal()), float(rng.normal()), float(rng.integers(0, 2))) for i in range(400)]
    noise = spark.createDataFrame(rows, "k long, a double, b double, y double")
    first, again = (boosted(noise.repartition(n), ["a", "b"], "y", "k", trees=40) for n in (2, 2))
    assert first.getNumTrees < 40 and first.getNumTrees == again.getNumTrees


def test_presets_learn_from_training_rows_alone(spark):
    from quarry.operators.tuning import PRESETS, preset_predictions

    d = learnable(spark, 150)
    train, test = d.where("k % 3 <> 0"), d.where("k % 3 = 0")
    spoilt = test.withColumn("y", F.when(F.col("k") % 2 == 0, "yes").otherwise("no"))
    for name in PRESETS:
        a, b = ({str(r["k"]): r["prediction"] for r in preset_predictions(train, t, ["a", "b", "c"], "y", "k", name).collect()} for t in (test, spoilt))
        assert a == b and len(a) == 50 and set(a.values()) <= {0.0, 1.0}


def test_one_vs_rest(spark):
    from quarry.operators.metrics import one_vs_rest

    rng = np.random.default_rng(3)
    p = rng.dirichlet([1, 1, 1], 200).round(1)
    y = np.array(["x", "y", "z"])[[int(rng.choice(3, p=v / v.sum())) for v in p]]
    df = spark.createDataFrame([(str(c), *map(float, v)) for c, v in zip(y, p)] + [(None, 0.1, 0.1, 0.1)], "y string, p0 double, p1 double, p2 double")
    got = {r["class"]: r for r in one_vs_rest(df, "y", {"x": "p0", "y": "p1", "z": "p2", "w": "p0"}).collect()}
    for j, c in enumerate("xyz"):
        s, t = p[:, j], y == c
        auc = np.mean([(a > b) + 0.5 * (a == b) for a in s[t] for b in s[~t]])
        ap, before = 0.0, 0
        for v in sorted(set(s), reverse=True):
            hit = t[s >= v].sum()
            ap, before = ap + (hit - before) / t.sum() * hit / (s >= v).sum(), hit
        assert got[c]["roc_auc"] == pytest.approx(auc) and got[c]["pr_auc"] == pytest.approx(ap)
    assert got["w"]["roc_auc"] is None and got[None]["roc_auc"] == pytest.approx(np.mean([got[c]["roc_auc"] for c in "xyz"]))


def test_ranks_of_whole_numbers_beyond_doubles(spark):
    from quarry.operators.ranks import average_ranks

    values = [2 ** 60 + i for i in range(200)]
    df = spark.createDataFrame([(v,) for v in values[::-1]], "v long").repartition(5)
    assert [r["avg_rank"] for r in average_ranks(df, "v").orderBy("v").collect()] == [float(i) for i in range(1, 201)]
    assert [r["avg_rank"] for r in average_ranks(df, "v", descending=True).orderBy(F.desc("v")).collect()] == [float(i) for i in range(1, 201)]


def test_intervals_and_categories(spark):
    from quarry.operators.profile import describe_categories, describe_intervals

    df = spark.createDataFrame([(1.0, "b"), (2.0, "a"), (3.0, "a"), (4.0, "b"), (None, None)], "x double, c string")
    r = describe_intervals(df, ["x"]).first()
    assert (r["ci_low"], r["ci_high"]) == (pytest.approx(2.5 - 3.182446 * 0.6454972, abs=1e-5), pytest.approx(2.5 + 3.182446 * 0.6454972, abs=1e-5))
    assert tuple(describe_categories(df, ["c"]).first()) == ("c", 4, 1, 2, "a", 50.0)
