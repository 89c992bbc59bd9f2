"""Registered queries: models, cross-validation, ensembles, clustering."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cluster as K
from ..operators import metrics as M
from ..operators import models as D
from ..session import cut_lineage
from ..sources.tables import read_table
from .fixtures import DIMS, order_features, points, vectors, vectors_sql
from .registry import register, rounded, sql_rounded

FEATS = ["o_totalprice", "c_acctbal", "n_lines", "avg_discount", "avg_quantity"]
SCALE = {f: [{"op": "scale", "method": "standard"}] for f in FEATS}


@register("model_logreg_cv")
def q_logreg_cv(spark, sf):
    """5-fold logistic regression, scaling refitted inside every fold."""
    cv = D.cross_validate(order_features(spark, sf), FEATS, "urgent", ["logistic"], "o_orderkey", 5,
                          plan=SCALE)
    return rounded(cv)


@register("model_compare_cv")
def q_compare(spark, sf):
    cv = D.cross_validate(order_features(spark, sf), FEATS, "urgent",
                          ["baseline", "logistic", "naive_bayes", "decision_tree", "random_forest"], "o_orderkey",
                          plan=SCALE)
    return rounded(D.rank_models(M.fold_summary(cv), "accuracy"))


@register("model_multiclass_cv")
def q_multi(spark, sf):
    cv = D.cross_validate(order_features(spark, sf), FEATS, "o_orderstatus", ["logistic", "naive_bayes", "decision_tree"],
                          "o_orderkey", plan=SCALE)
    return rounded(M.fold_summary(cv))


@register("model_boosting_mlp_cv")
def q_boost(spark, sf):
    """Gradient-boosted trees, linear SVM and an MLP on the binary target."""
    cv = D.cross_validate(order_features(spark, sf), FEATS, "urgent", ["gbt", "linear_svc", "mlp"], "o_orderkey",
                          plan=SCALE)
    return rounded(M.fold_summary(cv))


@register("model_regression_cv")
def q_reg(spark, sf):
    feats = ["c_acctbal", "n_lines", "avg_discount", "avg_quantity"]
    cv = D.cross_validate(order_features(spark, sf), feats, "o_totalprice",
                          ["baseline", "linear", "ridge", "lasso", "gbt", "random_forest"], "o_orderkey",
                          task="regression")
    return rounded(M.fold_summary(cv))


MEMBERS_SQL = """
select l_orderkey as k, 'a' as model, case when avg(l_discount) > 0.05 then 'high' else 'low' end as prediction,
  avg(l_discount) * 10 as p1 from lineitem group by l_orderkey
union all select l_orderkey, 'b', case when avg(l_quantity) > 25 then 'high' else 'low' end,
  avg(l_quantity) / 50 from lineitem group by l_orderkey
union all select l_orderkey, 'c', case when avg(l_tax) > 0.04 then 'high' else 'low' end,
  avg(l_tax) * 12.5 from lineitem group by l_orderkey"""


def _members(spark, sf):
    li = read_table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.avg("l_discount").alias("d"), F.avg("l_quantity").alias("qn"), F.avg("l_tax").alias("t"))
    parts = [li.select(F.col("l_orderkey").alias("k"), F.lit(m).alias("model"),
                       F.when(cond, "high").otherwise("low").alias("prediction"), prob.alias("p1"))
             for m, cond, prob in (("a", F.col("d") > 0.05, F.col("d") * 10), ("b", F.col("qn") > 25, F.col("qn") / 50),
                                   ("c", F.col("t") > 0.04, F.col("t") * 12.5))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("model_hard_vote", f"""with m as ({MEMBERS_SQL}),
g as (select k, prediction, cast(count(*) as double) as votes from m group by 1, 2),
r as (select *, row_number() over (partition by k order by votes desc, prediction) as rn from g)
select k, prediction, votes from r where rn = 1""")
def q_vote(spark, sf):
    return D.vote(_members(spark, sf), "k")


@register("model_soft_vote", sql_rounded(f"""with m as ({MEMBERS_SQL})
select k, sum(p1) / count(*) as mean from m group by k""", ["mean"]))
def q_soft(spark, sf):
    return rounded(D.soft_vote(_members(spark, sf), "k"))


@register("model_stacking")
def q_stack(spark, sf):
    return rounded(D.stacking(order_features(spark, sf), FEATS, "urgent", "o_orderkey", ["logistic", "naive_bayes"]))


@register("model_bagging")
def q_bag(spark, sf):
    from ..operators.prep import split
    d = split(order_features(spark, sf), "o_orderkey", 0.2, 42)
    tr, te = d.where(F.col("__split__") == "train"), d.where(F.col("__split__") == "test")
    return D.bagging(tr, te, FEATS, "urgent", "decision_tree", key="o_orderkey")


@register("model_unknown_labels", """
with s as (select o_orderkey, o_orderpriority,
  case when row_number() over (order by md5(concat_ws('|', '42', cast(o_orderkey as varchar)))) <=
    round_even(count(*) over () * 0.2, 0) then 'test' else 'train' end as sp from orders)
select distinct cast(o_orderpriority as varchar) as value from s where sp = 'test' and o_orderpriority is not null
  and o_orderpriority not in (select o_orderpriority from s where sp = 'train' and o_orderpriority <> '5-LOW')""")
def q_unknown(spark, sf):
    from ..operators.prep import split
    d = split(read_table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", 0.2, 42)
    train = d.where((F.col("__split__") == "train") & (F.col("o_orderpriority") != "5-LOW"))
    return D.unknown_labels(d.where(F.col("__split__") == "test"), train, "o_orderpriority")


XS = [f"x{i}" for i in range(DIMS)]


@register("cluster_kmeans_elbow")
def q_elbow(spark, sf):
    return rounded(K.elbow(points(spark, sf), ["embedding"], range(2, 11)))


@register("cluster_kmeans_sizes")
def q_kmeans(spark, sf):
    _, a = K.fit_clusters(points(spark, sf), ["embedding"], "kmeans", 10)
    return K.cluster_sizes(a)


@register("cluster_bisecting_sizes")
def q_bisect(spark, sf):
    _, a = K.fit_clusters(points(spark, sf), ["embedding"], "bisecting", 5)
    return K.cluster_sizes(a)


@register("cluster_gmm_sizes")
def q_gmm(spark, sf):
    _, a = K.fit_clusters(points(spark, sf), ["embedding"], "gmm", 3)
    return K.cluster_sizes(a)


def _scores_sql():
    d = DIMS
    x = XS
    cen = ", ".join(f"avg({c}) as m{i}" for i, c in enumerate(x))
    dist = " + ".join(f"power(v.{c} - c.m{i}, 2)" for i, c in enumerate(x))
    return sql_rounded(f"""with v as ({vectors_sql(d)}),
c as (select label, count(*) as n, {cen} from v group by label),
o as (select {', '.join(f'sum(n * m{i}) / sum(n) as o{i}' for i in range(d))}, sum(n) as n, count(*) as k from c),
s as (select c.label, avg(sqrt({dist})) as s, sum({dist}) as w from v join c on v.label = c.label group by c.label),
pair as (select a.label, max((sa.s + sb.s) / sqrt({' + '.join(f'power(a.m{i} - b.m{i}, 2)' for i in range(d))})) as r
         from c a join c b on a.label <> b.label join s sa on sa.label = a.label join s sb on sb.label = b.label
         group by a.label)
select (select avg(r) from pair) as davies_bouldin,
  ((select sum(c.n * ({' + '.join(f'power(c.m{i} - o.o{i}, 2)' for i in range(d))})) from c, o) / (max(o.k) - 1)) /
  ((select sum(w) from s) / (max(o.n) - max(o.k))) as calinski_harabasz, cast(max(o.k) as integer) as clusters
from o""", ["davies_bouldin", "calinski_harabasz"])


@register("cluster_scores_given_labels", _scores_sql())
def q_scores(spark, sf):
    v = vectors(spark, sf).withColumnRenamed("label", "cluster")
    return rounded(K.centroid_scores(v, XS))


@register("cluster_silhouette_kmeans")
def q_sil(spark, sf):
    _, a = K.fit_clusters(points(spark, sf), ["embedding"], "kmeans", 10)
    return spark.createDataFrame([(K.silhouette(a, ["embedding"]),)], "silhouette double")


@register("cluster_pca_view")
def q_pca_view(spark, sf):
    return K.pca_view(vectors(spark, sf), XS, "vec_id", 2000)


# ---- explanations and model utilities ---------------------------------------------------------

def _split_features(spark, sf):
    from ..operators.prep import split
    d = cut_lineage(split(order_features(spark, sf), "o_orderkey", 0.2, 42, "urgent"))  # ranked once, read by every pass
    return d.where(F.col("__split__") == "train"), d.where(F.col("__split__") == "test")


@register("explain_native_importance")
def q_native(spark, sf):
    from ..operators import explain as X
    tr, _ = _split_features(spark, sf)
    model, _ = X.fit_model(tr, FEATS, "urgent", "random_forest")
    return rounded(spark.createDataFrame(X.native_importance(model, FEATS), "feature string, share double"))


@register("explain_linear_shap")
def q_shap(spark, sf):
    from ..operators import explain as X
    tr, te = _split_features(spark, sf)
    model, _ = X.fit_model(tr, FEATS, "urgent", "logistic")
    return rounded(X.linear_shap(te, tr, FEATS, list(model.coefficients.toArray())))


@register("explain_partial_dependence")
def q_pdp(spark, sf):
    from ..operators import explain as X
    tr, te = _split_features(spark, sf)
    model, _ = X.fit_model(tr, FEATS, "urgent", "random_forest")
    return rounded(X.partial_dependence(model, te, FEATS, "o_totalprice", "o_orderkey"))


@register("explain_permutation_importance")
def q_perm(spark, sf):
    from ..operators import explain as X
    tr, te = _split_features(spark, sf)
    model, classes = X.fit_model(tr, FEATS, "urgent", "decision_tree")
    return rounded(X.permutation_importance(model, te, FEATS, "urgent", "o_orderkey", classes))


@register("model_grid_search")
def q_grid(spark, sf):
    from ..operators import explain as X
    grid = [{"max_depth": d} for d in (2, 4, 6)]
    return rounded(X.grid_search(order_features(spark, sf), FEATS, "urgent", "decision_tree", grid, "o_orderkey", 3))


@register("model_learning_curve")
def q_lc(spark, sf):
    from ..operators import explain as X
    return rounded(X.learning_curve(order_features(spark, sf), FEATS, "urgent", "naive_bayes", "o_orderkey"))


@register("model_predict_table")
def q_predict(spark, sf):
    from ..operators import explain as X
    from ..operators.prep import fit_prep
    tr, te = _split_features(spark, sf)
    state = fit_prep(tr, SCALE, "o_orderkey")
    from ..operators.prep import transform
    model, classes = X.fit_model(transform(state, tr), FEATS, "urgent", "logistic")
    return X.predict_table(model, state, te, FEATS, classes, "o_orderkey")


@register("prep_apply_plan_holdout")
def q_apply_plan(spark, sf):
    from ..operators import explain as X
    rest, _valid = X.validation_holdout(order_features(spark, sf), "o_orderkey", 0.1, 42, "urgent")
    out, _ = X.apply_plan(rest, SCALE, "o_orderkey", "urgent")
    return rounded(out.groupBy("__split__").agg(F.count(F.lit(1)).alias("rows"),
                                                  F.avg("o_totalprice").alias("mean_scaled_price")))


@register("stat_normality_table")
def q_normality(spark, sf):
    from ..operators import explain as X
    from .fixtures import survey
    return rounded(X.normality_table(survey(spark, sf), ["pre", "post"], "grp"))


@register("prep_iterative_impute")
def q_iter_impute(spark, sf):
    """PRE-02 on order features with the balance of every 7th customer blanked."""
    from ..operators import advanced as A
    d = order_features(spark, sf).withColumn(
        "c_acctbal", F.when(F.col("o_orderkey") % 7 == 0, None).otherwise(F.col("c_acctbal")))
    cols = ["o_totalprice", "c_acctbal", "n_lines", "avg_quantity"]
    st = A.iterative_impute(d, cols)
    return rounded(A.apply_iterative(st, d).select("o_orderkey", *cols))


@register("prep_rfe")
def q_rfe(spark, sf):
    from ..operators import advanced as A
    return A.rfe(order_features(spark, sf).withColumn("y", F.col("urgent").cast("int")), FEATS, "y", 2)


@register("model_adaboost")
def q_ada(spark, sf):
    from ..operators import advanced as A
    tr, te = _split_features(spark, sf)
    ens, classes = A.adaboost(tr, FEATS, "urgent")
    pred = A.adaboost_predict(ens, classes, te, FEATS)
    return M.classification_metrics(pred, "urgent", "prediction")


@register("prep_isolation_forest")
def q_iforest(spark, sf):
    from ..operators import advanced as A
    tr, _ = _split_features(spark, sf)
    kept = A.remove_isolated(tr, FEATS, "o_orderkey", 0.05)
    return kept.agg(F.count(F.lit(1)).alias("rows_kept"))


@register("explain_lime")
def q_lime(spark, sf):
    """LIME for the five test rows with the smallest md5 keys."""
    from ..operators import explain as X
    from ..operators.charts import sample_rows
    tr, te = _split_features(spark, sf)
    model, _ = X.fit_model(tr, FEATS, "urgent", "random_forest")
    return rounded(X.lime(model, tr, sample_rows(te, "o_orderkey", 5), FEATS, "o_orderkey"))


def _knn_sql(k: int, dims: int = DIMS):
    x = [f"x{i}" for i in range(dims)]
    dist = " + ".join(f"power(v.{c} - g.{c}, 2)" for c in x)
    return f"""with v as ({vectors_sql(dims)}),
g as (select {', '.join(x)}, min(vec_id) as rk, count(*) as m from v group by {', '.join(x)}),
d as (select v.vec_id as lk, g.rk, sqrt({dist}) as distance, g.m from v cross join g),
o as (select *, row_number() over (partition by lk order by distance, rk) as rn,
      coalesce(sum(m) over (partition by lk order by distance, rk rows between unbounded preceding and 1 preceding), 0)
        as before from d)"""


@register("knn_join_embeddings", sql_rounded(_knn_sql(5) + """
select lk as vec_id, rk as neighbor_id, distance, cast(m as bigint) as multiplicity, cast(rn as integer) as rank,
  cast(least(m, 5 - before) as bigint) as weight
from o where before < 5""", ["distance"]))
def q_knn(spark, sf):
    from ..operators.knn import knn_join
    v = points(spark, sf)
    return rounded(knn_join(v, "vec_id", v.withColumnRenamed("vec_id", "neighbor_id"), "neighbor_id",
                            ["embedding"], 5, leaf_rows=64))


@register("cluster_k_distance", sql_rounded(_knn_sql(5) + """,
c as (select lk, distance, sum(m) over (partition by lk order by distance, rk rows between unbounded preceding
      and current row) - 1 as cum from d)
select lk as vec_id, min(distance) as k_distance from c where cum >= 4 group by lk""", ["k_distance"]))
def q_kdist(spark, sf):
    from ..operators.knn import k_distance
    return rounded(k_distance(points(spark, sf), "vec_id", ["embedding"], 4))


def _knn_split_sql():
    return f"""with v as ({vectors_sql()}),
s as (select *, case when row_number() over (order by md5(concat_ws('|', '42', cast(vec_id as varchar)))) <=
      round_even(count(*) over () * 0.2, 0) then 'test' else 'train' end as sp from v),
tr as (select * from s where sp = 'train'), te as (select * from s where sp = 'test'),
g as (select {", ".join(XS)}, label, min(vec_id) as rk, count(*) as m from tr group by {", ".join(XS)}, label),
d as (select te.vec_id as lk, g.rk, g.label, g.m,
      sqrt({" + ".join(f"power(te.{x} - g.{x}, 2)" for x in XS)}) as dist
      from te cross join g),
o as (select *, coalesce(sum(m) over (partition by lk order by dist, rk rows between unbounded preceding and 1 preceding),
      0) as before from d),
w as (select lk, label, least(m, 5 - before) as wt from o where before < 5)"""


@register("model_knn_classifier", _knn_split_sql() + """,
vt as (select lk, label, sum(wt) as votes from w group by lk, label),
r as (select *, row_number() over (partition by lk order by votes desc, label) as rn from vt)
select lk as vec_id, label as prediction, cast(votes as bigint) as votes from r where rn = 1""")
def q_knn_cls(spark, sf):
    from ..operators.knn import knn_predict
    from ..operators.prep import split
    v = points(spark, sf)
    s = v.join(split(v.select("vec_id"), "vec_id", 0.2, 42), "vec_id")  # only ids are ranked
    tr, te = s.where(F.col("__split__") == "train"), s.where(F.col("__split__") == "test")
    return knn_predict(tr, te, ["embedding"], "label", "vec_id", "vec_id", 5).withColumn("votes", F.col("votes").cast("long"))


@register("model_knn_regressor", sql_rounded(_knn_split_sql() + """
select lk as vec_id, sum(wt * label) / sum(wt) as prediction from w group by lk""", ["prediction"]))
def q_knn_reg(spark, sf):
    from ..operators.knn import knn_predict
    from ..operators.prep import split
    v = points(spark, sf).withColumn("label", F.col("label").cast("double"))
    s = v.join(split(v.select("vec_id"), "vec_id", 0.2, 42), "vec_id")
    tr, te = s.where(F.col("__split__") == "train"), s.where(F.col("__split__") == "test")
    return rounded(knn_predict(tr, te, ["embedding"], "label", "vec_id", "vec_id", 5, "regression"))


@register("prep_knn_impute")
def q_knn_impute(spark, sf):
    """PRE-01: x3 blanked for every 5th vector, filled from its 5 nearest train rows."""
    from ..operators.knn import knn_impute
    v = vectors(spark, sf).withColumn("x3", F.when(F.col("vec_id") % 5 == 0, None).otherwise(F.col("x3")))
    return rounded(knn_impute(v, v, [x for x in XS if x != "x3"], "x3", "vec_id", 5).select("vec_id", "x3"))


@register("prep_smote_counts")
def q_smote(spark, sf):
    """PRE-11: classes balanced by SMOTE on the embedding coordinates."""
    from ..operators.knn import smote
    return smote(points(spark, sf), ["embedding"], "label", "vec_id", 5).groupBy("label").agg(F.count(F.lit(1)).alias("rows"))
