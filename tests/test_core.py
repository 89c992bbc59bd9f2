"""Core operators against brute force and hand-worked values."""
import json
import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import biblio as B
from quarry.operators import clean as C
from quarry.operators import metrics as M
from quarry.operators import prep as R
from quarry.operators.ranks import average_ranks, exact_quantiles, prefix_sums


def _avg_rank_brute(vals):
    v = np.asarray(vals, float)
    order = np.argsort(v, kind="mergesort")
    ranks = np.empty(len(v))
    ranks[order] = np.arange(1, len(v) + 1)
    out = {}
    for x in np.unique(v):
        out[x] = ranks[v == x].mean()
    return out


def test_average_ranks_match_brute_force(spark):
    rng = np.random.default_rng(0)
    vals = list(rng.integers(0, 40, 500).astype(float)) + [7.0] * 300  # one value holds a third of the rows
    df = spark.createDataFrame([(float(x),) for x in vals], "v double")
    got = {r["v"]: r["avg_rank"] for r in average_ranks(df, "v", buckets=7).collect()}
    want = _avg_rank_brute(vals)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k])


def test_prefix_sums_grouped_and_descending(spark):
    rows = [(g, float(x), 1) for g in ("a", "b") for x in range(50)]
    df = spark.createDataFrame(rows, "g string, v double, one int")
    got = {(r["g"], r["v"]): r["cum_one"] for r in prefix_sums(df, "v", ["one"], by=["g"], descending=True,
                                                                   buckets=4).collect()}
    assert got[("a", 49.0)] == 1 and got[("a", 0.0)] == 50 and got[("b", 25.0)] == 25


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    vals = rng.normal(size=333)
    df = spark.createDataFrame([(float(x),) for x in vals], "value double")
    r = exact_quantiles(df, [0.1, 0.25, 0.5, 0.9]).first()
    for i, p in enumerate([0.1, 0.25, 0.5, 0.9]):
        assert r[f"q_{i}"] == pytest.approx(float(np.percentile(vals, p * 100)), abs=1e-12)


def test_h_and_g_index_hand_worked(spark):
    rows = [(i, ["x"], c, 2000) for i, c in enumerate([10, 8, 5, 4, 3])]
    rows += [(10 + i, ["y"], c, 2000) for i, c in enumerate([25, 8, 5, 3, 3])]
    df = spark.createDataFrame(rows, "doc_id long, authors array<string>, citations long, year int")
    got = {r["author"]: r for r in B.author_impact(df, 2000, None).collect()}
    assert (got["x"]["h_index"], got["x"]["g_index"]) == (4, 5)
    assert got["y"]["h_index"] == 3


def test_gram_counts_match_pairs(spark):
    rng = np.random.default_rng(2)
    sets = [sorted(set(rng.integers(0, 6, rng.integers(1, 5)).tolist())) for _ in range(200)]
    df = spark.createDataFrame([(s,) for s in sets], "idx array<int>")
    got = {(r["i"], r["j"]): r["weight"] for r in B.gram_counts(df.repartition(3), "idx", 6).collect()}
    want = {}
    for s in sets:
        for a in s:
            for b in s:
                if a <= b:
                    want[(a, b)] = want.get((a, b), 0) + 1
    assert got == want


def test_modularity_two_triangles(spark):
    edges = [("a", "b", 1), ("b", "c", 1), ("a", "c", 1), ("d", "e", 1), ("e", "f", 1), ("d", "f", 1), ("c", "d", 1)]
    e = spark.createDataFrame(edges, "a string, b string, weight long")
    lab = spark.createDataFrame([(n, 0 if n in "abc" else 1) for n in "abcdef"], "node string, community int")
    q = B.modularity(e, lab).first()["modularity"]
    assert q == pytest.approx(5 / 14, abs=1e-9)  # hand-worked: 2*(3/7 - (7/14)^2)


def test_auc_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 300)
    s = np.round(rng.random(300), 2)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double")
    got = M.roc_auc(df, "y", "s").first()["roc_auc"]
    pos, neg = s[y == 1], s[y == 0]
    want = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert got == pytest.approx(want)


def test_clean_refusals_and_decisions(spark):
    df = spark.createDataFrame([(" Male", "1,200", "03/04/2020"), ("male ", "25", "25/12/2020"),
                                ("FEMALE", None, None)], "sex string, amount string, d string")
    with pytest.raises(ValueError):
        C.apply_clean(df, [{"op": "reverse_score", "column": "amount", "low": 5, "high": 1}])
    with pytest.raises(ValueError):
        C.apply_clean(df, [{"op": "nope"}])
    out, ops = C.apply_clean(df, [{"op": "merge_categories", "column": "sex"},
                                  {"op": "retype", "column": "amount", "to": "number"},
                                  {"op": "retype", "column": "d", "to": "datetime"}])
    assert ops[1]["commas"] == C.THOUSANDS and ops[1]["integer"] is True
    assert ops[2]["dayfirst"] is True
    rows = out.orderBy("amount").collect()
    assert sorted(r["sex"] for r in rows) == ["female", "male", "male"]
    assert {r["amount"] for r in rows} == {None, 25, 1200}
    days = {str(r["d"])[:10] for r in rows if r["d"] is not None}
    assert days == {"2020-04-03", "2020-12-25"}


def test_prep_replay_is_idempotent_and_streamable(spark):
    rows = [(i, float(i % 7) if i % 5 else None, "abc"[i % 3]) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, x double, c string")
    plan = {"x": [{"op": "impute", "strategy": "median"}, {"op": "scale", "method": "robust"}],
            "c": [{"op": "encode", "method": "onehot"}]}
    st = R.fit_prep(df, plan)
    a = R.transform(st, df).orderBy("k").collect()
    st2 = json.loads(json.dumps(st))  # state survives a JSON round trip
    b = R.transform(st2, df).orderBy("k").collect()
    assert a == b and len(a) == 60
    assert {"c_a", "c_b", "c_c"} <= set(R.transform(st, df).columns)


def test_split_is_reproducible_and_exact(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(101)], "k long, y string")
    s1 = R.split(df, "k", 0.2, 7, "y")
    s2 = R.split(df.repartition(5), "k", 0.2, 7, "y")
    t1 = {r["k"] for r in s1.where("__split__ = 'test'").collect()}
    t2 = {r["k"] for r in s2.where("__split__ = 'test'").collect()}
    assert t1 == t2 and len(t1) == round(51 * 0.2) + round(50 * 0.2)


def test_json_column_form(spark):
    from quarry.sources.files import read_json_records
    d = tempfile.mkdtemp(prefix="quarry-test-")
    p = os.path.join(d, "cols.json")
    with open(p, "w") as f:
        json.dump({"a": [1, 2, 3], "b": ["x", "y", "z"]}, f)
    out = read_json_records(spark, p).orderBy("a").collect()
    assert [(r["a"], r["b"]) for r in out] == [(1, "x"), (2, "y"), (3, "z")]


def test_registry_oracles_have_queries():
    import __spark_entry__ as E
    qs, sq = E.queries(), E.oracle_sql()
    assert set(sq) <= set(qs)
    assert len(qs) >= 150


def test_knn_join_exact_with_hot_duplicate(spark):
    from quarry.operators.knn import knn_join
    rng = np.random.default_rng(5)
    pts = rng.normal(size=(240, 2)).round(3).tolist() + [[0.5, 0.5]] * 120  # one point = a third of the rows
    ref = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)], "rid long, a double, b double")
    qs = rng.normal(size=(40, 2)).tolist()
    qry = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(qs)], "qid long, a double, b double")
    got = knn_join(qry, "qid", ref, "rid", ["a", "b"], 5, leaf_rows=8).collect()
    # brute force over distinct coordinates (min key), multiplicities, ties by key
    groups = {}
    for i, p in enumerate(pts):
        g = groups.setdefault(tuple(p), [i, 0])
        g[1] += 1
    for qi, qp in enumerate(qs):
        cand = sorted((float(np.hypot(qp[0] - c[0], qp[1] - c[1])), k, m) for c, (k, m) in groups.items())
        want, tot = [], 0
        for d, k, m in cand:
            if tot >= 5:
                break
            want.append(k)
            tot += m
        mine = [r["rid"] for r in sorted((r for r in got if r["qid"] == qi), key=lambda r: r["rank"])]
        assert mine == want


@pytest.mark.parametrize("dims, tile", [(2, (16, 64)), (12, (16, 64)), (12, (10_000, 10_000))])
def test_knn_join_in_tiles_is_the_brute_force_one(spark, monkeypatch, dims, tile):
    """Tiles smaller than a block, multiplicities, ties, a hot point with many carried values; points with NaN ask nothing."""
    from quarry.operators import knn as N
    monkeypatch.setattr(N, "FIRST_ROUND", 16)
    rng = np.random.default_rng(dims)
    x = np.concatenate([rng.normal(1000, 1, (150, dims)).round(1), rng.normal(1003, 0.2, (100, dims)).round(1), np.full((70, dims), 1000.0), np.full((3, dims), np.nan)])
    rows = [(i, v.tolist(), i % 90) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "k long, x array<double>, w int").repartition(4)
    got = {}
    for r in N.knn_join(df, "k", df.withColumnRenamed("k", "n"), "n", ["x"], 5, leaf_rows=8, carry=["w"], tile=tile).collect():
        got.setdefault(r["k"], []).append((r["rank"], r["n"], r["multiplicity"], r["w"]))
    groups = {}
    for i, v, w in rows:
        g = groups.setdefault((str(v), w), [i, 0])
        g[1] += 1
    for i, v, _ in rows:
        order = sorted((bool(np.isnan(d)), 0.0 if np.isnan(d) else d, n, m, w) for (_, w), (n, m) in groups.items() for d in [np.sqrt(((x[i] - x[n]) ** 2).sum())])
        want, total = [], 0
        for _, _, n, m, w in order:
            if total < 5:
                want.append((len(want) + 1, n, m, w))
            total += m
        assert sorted(got.get(i, [])) == (want if np.isfinite(x[i]).all() else [])
