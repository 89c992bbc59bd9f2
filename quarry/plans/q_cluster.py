"""Registered queries: DBSCAN, Euclidean silhouettes, comparison of methods, tree SHAP."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cluster as K
from ..operators import density as N
from ..operators import treeshap as S
from ..operators.explain import fit_model
from ..sources.tables import read_table
from .fixtures import points
from .q_models import FEATS, _split_features
from .registry import register, rounded, sql_rounded

EPS, MIN_SAMPLES = 1.0, 5

PART_POINTS_SQL = """select l_partkey as k, [avg(l_quantity) / 2, avg(l_discount) * 100, 10.0 * (l_partkey % 4)] as x
from lineitem group by l_partkey"""


def part_points(spark, sf):
    """One point per part: mean quantity and discount, four bands by key."""
    li = read_table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.avg("l_quantity").alias("a"), F.avg("l_discount").alias("d"))
    return li.select(F.col("l_partkey").alias("k"), F.array(F.col("a") / 2, F.col("d") * 100, F.lit(10.0) * (F.col("l_partkey") % 4)).alias("x"))


DBSCAN_SQL = f"""with recursive v as ({PART_POINTS_SQL}),
near as (select a.k as a, b.k as b from v a join v b on list_distance(a.x, b.x) <= {EPS}),
core as (select a as k from near group by a having count(*) >= {MIN_SAMPLES}),
links as (select a, b from near where a in (select k from core) and b in (select k from core)),
reach(a, b) as (select k, k from core union select r.a, l.b from reach r join links l on r.b = l.a),
roots as (select a as k, min(b) as root from reach group by a),
clusters as (select k, dense_rank() over (order by root) - 1 as cluster from roots),
border as (select n.a as k, min(c.cluster) as cluster from near n join clusters c on n.b = c.k
  where n.a not in (select k from core) group by n.a)
select v.k, cast(coalesce(c.cluster, b.cluster, -1) as bigint) as cluster,
  case when c.k is not null then 'core' when b.k is not null then 'border' else 'noise' end as kind
from v left join clusters c on c.k = v.k left join border b on b.k = v.k"""


@register("cluster_dbscan", DBSCAN_SQL)
def q_dbscan(spark, sf):
    return N.dbscan(part_points(spark, sf), "k", ["x"], EPS, MIN_SAMPLES)


@register("cluster_dbscan_sizes", f"""select cluster, count(*) as size from ({DBSCAN_SQL}) group by cluster""")
def q_dbscan_sizes(spark, sf):
    return K.cluster_sizes(N.dbscan(part_points(spark, sf), "k", ["x"], EPS, MIN_SAMPLES))


SILHOUETTE_SQL = f"""with v as (select vec_id, label, cast(embedding as double[]) as x from embeddings
  where label is not null and label <> -1 order by md5(concat_ws('|', '42', cast(vec_id as varchar))), vec_id limit {N.SILHOUETTE_ROWS}),
sums as (select a.vec_id, a.label, b.label as other, sum(list_distance(a.x, b.x)) as total, count(*) as n
  from v a join v b on true group by a.vec_id, a.label, b.label),
own as (select vec_id, label, total / (n - 1) as a, n from sums where other = label),
best as (select vec_id, min(total / n) as b from sums where other <> label group by vec_id)
select vec_id, own.label as label, case when own.n = 1 then 0.0 else (b - a) / greatest(a, b) end as silhouette
from own join best using (vec_id)"""


def _labelled_silhouettes(spark, sf):
    return N.silhouette_rows(points(spark, sf), "vec_id", ["embedding"], "label")


@register("cluster_silhouette_rows", sql_rounded(SILHOUETTE_SQL, ["silhouette"], 8))
def q_silhouette_rows(spark, sf):
    return rounded(_labelled_silhouettes(spark, sf), 8)


@register("cluster_silhouette_bars", f"""with s as ({SILHOUETTE_SQL}),
r as (select *, count(*) over (partition by label) as size,
  row_number() over (partition by label order by silhouette desc) - 1 as place from s),
w as (select distinct label, round_even(j * (size - 1) / greatest(least(size, {N.SHOWN_VALUES}) - 1, 1), 0) as place
  from (select label, size, unnest(range(least(size, {N.SHOWN_VALUES}))) as j from r))
select r.label, size, cast(r.place as integer) as place, round(silhouette, 4) as value
from r join w on r.label = w.label and r.place = w.place""")
def q_silhouette_bars(spark, sf):
    return N.silhouette_bars(_labelled_silhouettes(spark, sf), "label")


@register("cluster_compare_methods")
def q_compare(spark, sf):
    """Every method on the part points, with the Euclidean silhouette of each."""
    return rounded(K.compare_methods(part_points(spark, sf), "k", ["x"], 4, EPS, MIN_SAMPLES))


def _forest_shap(spark, sf):
    train, test = _split_features(spark, sf)
    model, _ = fit_model(train, FEATS, "urgent", "random_forest")
    return test, S.tree_shap(model, test, FEATS, "o_orderkey")


@register("explain_tree_shap")
def q_tree_shap(spark, sf):
    """Shapley values of a random forest for every test row; base + their sum is the output."""
    _, shap = _forest_shap(spark, sf)
    return rounded(shap.select("o_orderkey", "base", "output", *[F.col("phi")[i].alias(f) for i, f in enumerate(FEATS)]))


@register("explain_shap_summary")
def q_shap_summary(spark, sf):
    return rounded(S.shap_summary(_forest_shap(spark, sf)[1], FEATS))


@register("explain_shap_dots")
def q_shap_dots(spark, sf):
    """Boosted trees: values of the strongest features for a sample, coloured by percent rank."""
    train, test = _split_features(spark, sf)
    model, _ = fit_model(train, FEATS, "urgent", "gbt")
    return rounded(S.shap_dots(S.tree_shap(model, test, FEATS, "o_orderkey"), test, FEATS, "o_orderkey"))
