"""Registered queries: evaluation metrics (EVL-*) and chart data (CHT-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import charts as C
from ..operators import metrics as M
from ..sources.tables import read_table
from .fixtures import (DIRTY_ORDERS_SQL, MULTICLASS_SQL, REGRESSION_SQL, SCORED_SQL, dirty_orders,
                       multiclass_scored, regression_scored, scored)
from .registry import register, rounded, sql_rounded

SC = f"sc as ({SCORED_SQL})"
THRESH = 0.15


@register("eval_confusion_multiclass", f"""with mc as ({MULTICLASS_SQL}),
l as (select distinct actual as v from mc union select distinct predicted from mc),
c as (select actual, predicted, count(*) as n from mc group by 1, 2)
select a.v as actual, b.v as predicted, cast(coalesce(c.n, 0) as bigint) as count
from l a cross join l b left join c on c.actual = a.v and c.predicted = b.v""")
def q_confusion(spark, sf):
    return M.confusion(multiclass_scored(spark, sf), "actual", "predicted")


@register("eval_classification_binary", sql_rounded(f"""with {SC},
c as (select count_if(y = 1 and score >= {THRESH}) as tp, count_if(y = 0 and score >= {THRESH}) as fp,
             count_if(y = 1 and score < {THRESH}) as fn, count_if(y = 0 and score < {THRESH}) as tn from sc),
m as (select *, tp + fp + fn + tn as n, case when tp + fp > 0 then tp / (tp + fp) else 0 end as pr,
      case when tp + fn > 0 then tp / (tp + fn) else 0 end as rc, case when tn + fp > 0 then tn / (tn + fp) else 0 end as sp
      from c)
select cast(n as bigint) as n, (tp + tn) / n as accuracy, (rc + sp) / 2 as balanced_accuracy, pr as precision,
  rc as recall, sp as specificity, case when pr + rc > 0 then 2 * pr * rc / (pr + rc) else 0 end as f1,
  ((tp + tn) * n - ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp))) /
    sqrt((n * n - (power(tp + fp, 2) + power(tn + fn, 2))) * (n * n - (power(tp + fn, 2) + power(tn + fp, 2)))) as mcc,
  ((tp + tn) / n - ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (n * n)) /
    (1 - ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (n * n)) as kappa
from m""", ["accuracy", "balanced_accuracy", "precision", "recall", "specificity", "f1", "mcc", "kappa"]))
def q_cls_binary(spark, sf):
    s = scored(spark, sf).withColumn("pred", (F.col("score") >= THRESH).cast("int"))
    return rounded(M.classification_metrics(s, "y", "pred", "1"))


@register("eval_classification_multiclass", sql_rounded(f"""with mc as ({MULTICLASS_SQL}),
l as (select distinct actual as v from mc union select distinct predicted from mc),
per as (select l.v, count_if(mc.actual = l.v) as t, count_if(mc.predicted = l.v) as p,
        count_if(mc.actual = l.v and mc.predicted = l.v) as tp from l cross join mc group by l.v),
tot as (select count(*) as n, count_if(actual = predicted) as correct from mc),
x as (select per.*, tot.n, tot.correct,
      case when p > 0 then tp / p else 0 end as prec, case when t > 0 then tp / t else 0 end as rec,
      case when n - t > 0 then (n - t - p + tp) / (n - t) else 0 end as spec from per, tot)
select cast(max(n) as bigint) as n, max(correct) / max(n) as accuracy,
  sum(case when t > 0 then rec end) / count_if(t > 0) as balanced_accuracy, avg(prec) as precision, avg(rec) as recall,
  avg(spec) as specificity, avg(case when prec + rec > 0 then 2 * prec * rec / (prec + rec) else 0 end) as f1,
  (max(correct) * max(n) - sum(p * t)) / sqrt((power(max(n), 2) - sum(p * p)) * (power(max(n), 2) - sum(t * t))) as mcc,
  (max(correct) / max(n) - sum(p * t) / power(max(n), 2)) / (1 - sum(p * t) / power(max(n), 2)) as kappa
from x""", ["accuracy", "balanced_accuracy", "precision", "recall", "specificity", "f1", "mcc", "kappa"]))
def q_cls_multi(spark, sf):
    return rounded(M.classification_metrics(multiclass_scored(spark, sf), "actual", "predicted"))


@register("eval_roc_auc", sql_rounded(f"""with {SC},
r as (select y, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0 as rk from sc
      where score is not null),
a as (select sum(case when y = 1 then rk else 0 end) as R, count_if(y = 1) as P, count_if(y = 0) as N from r)
select (R - P * (P + 1) / 2.0) / (P * N) as roc_auc, cast(P as bigint) as positives, cast(N as bigint) as negatives
from a""", ["roc_auc"]))
def q_auc(spark, sf):
    return rounded(M.roc_auc(scored(spark, sf), "y", "score"))


DESC_SQL = f"""with {SC},
t as (select score as s, count(*) as n, sum(y) as npos from sc where score is not null group by score),
c as (select s, n, npos, sum(n) over (order by s desc rows between unbounded preceding and current row) as cum_n,
      sum(npos) over (order by s desc rows between unbounded preceding and current row) as cum_npos,
      row_number() over (order by s desc) - 1 as idx from t)"""


@register("eval_pr_auc", sql_rounded(DESC_SQL + """
select sum(npos / (select sum(npos) from t) * cum_npos / cum_n) as pr_auc from c""", ["pr_auc"]))
def q_ap(spark, sf):
    return rounded(M.average_precision(scored(spark, sf), "y", "score"))


@register("eval_curve_points", sql_rounded(DESC_SQL + """,
tot as (select sum(npos) as PP, sum(n - npos) as NN, count(*) as m from t),
k as (select distinct cast(round(i * (m - 1) / 199.0) as bigint) as idx from tot, range(200) as g(i) where m > 200
      union all select idx from c, tot where m <= 200)
select c.s as threshold, cast(c.idx as bigint) as idx, (cum_n - cum_npos) / greatest(NN, 1) as fpr,
  cum_npos / greatest(PP, 1) as tpr, cum_npos / greatest(PP, 1) as recall, cum_npos / cum_n as precision
from c join k on c.idx = k.idx, tot""", ["threshold", "fpr", "tpr", "recall", "precision"]))
def q_curves(spark, sf):
    return rounded(M.curve_points(scored(spark, sf), "y", "score"))


@register("eval_losses", sql_rounded(f"""with {SC}
select avg(-(y * ln(least(greatest(score, 2.220446049250313e-16), 1 - 2.220446049250313e-16))
          + (1 - y) * ln(1 - least(greatest(score, 2.220446049250313e-16), 1 - 2.220446049250313e-16)))) as log_loss,
  avg(power(score - y, 2)) as brier from sc""", ["log_loss", "brier"]))
def q_losses(spark, sf):
    return rounded(M.probability_losses(scored(spark, sf), "y", "score"))


@register("eval_regression", sql_rounded(f"""with rg as ({REGRESSION_SQL}),
a as (select count(*) as n, avg(abs(actual - predicted)) as mae, avg(power(actual - predicted, 2)) as mse,
      var_pop(actual) as vy, count_if(actual = 0) as zeros,
      avg(abs(actual - predicted) / greatest(abs(actual), 2.220446049250313e-16)) as mape
      from rg where actual is not null and predicted is not null)
select cast(n as bigint) as n, mae, mse, sqrt(mse) as rmse, 1 - mse / vy as r2,
  case when n - 2 > 0 then 1 - (mse / vy) * (n - 1) / (n - 2) end as adj_r2, case when zeros = 0 then mape end as mape
from a""", ["mae", "mse", "rmse", "r2", "adj_r2", "mape"]))
def q_regression(spark, sf):
    return rounded(M.regression_metrics(regression_scored(spark, sf), "actual", "predicted", 1))


def _cal_sql():
    edges = [i * 0.1 for i in range(1, 10)]
    b = " + ".join(f"cast(score > {e!r} as integer)" for e in edges)
    return sql_rounded(f"""with {SC}
select {b} as bin, avg(score) as predicted, avg(cast(y as double)) as observed, cast(count(*) as bigint) as count
from sc where score is not null group by 1""", ["predicted", "observed"])


@register("eval_calibration", _cal_sql())
def q_calibration(spark, sf):
    return rounded(M.calibration(scored(spark, sf), "y", "score"))


@register("eval_residuals", sql_rounded(f"""with rg as ({REGRESSION_SQL})
select cast(count(actual - predicted) as bigint) as n, avg(actual - predicted) as residual_mean,
  stddev_samp(actual - predicted) as residual_sd from rg""", ["residual_mean", "residual_sd"]))
def q_residuals(spark, sf):
    return rounded(M.residual_summary(regression_scored(spark, sf), "actual", "predicted"))


def _hist_sql(src: str, col: str, extra_where: str = "true") -> str:
    return f"""with src as ({src}), d as (select cast({col} as double) as v from src where {col} is not null and {extra_where}),
s as (select count(*) as n, min(v) as lo, max(v) as hi, quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.75) as q3 from d),
w as (select *, (hi - lo) / (log2(n) + 1.0) as sturges, 2.0 * (q3 - q1) * power(n, -1.0 / 3.0) as fd from s),
b as (select *, case when hi <= lo then 1 else greatest(1, cast(ceil((hi - lo) / (case when fd > 0 then least(fd, sturges)
      else sturges end)) as bigint)) end as bins from w),
h as (select case when hi <= lo then 0 else least(floor((v - lo) / (hi - lo) * bins), bins - 1) end as bin from d, b)
select cast(bin as integer) as bin, max(lo) + bin * (max(hi) - max(lo)) / max(bins) as lo,
  max(lo) + (bin + 1) * (max(hi) - max(lo)) / max(bins) as hi, cast(count(*) as bigint) as count
from h, b group by bin"""


@register("eval_residual_histogram", sql_rounded(_hist_sql(REGRESSION_SQL.replace(
    "select l_extendedprice as actual", "select l_extendedprice - l_quantity * p_retailprice * 0.97 as residual, "
    "l_extendedprice as actual"), "residual"), ["lo", "hi"]))
def q_resid_hist(spark, sf):
    return rounded(M.residual_histogram(regression_scored(spark, sf), "actual", "predicted"))


@register("eval_qq_points")
def q_qq(spark, sf):
    r = regression_scored(spark, sf).select((F.col("actual") - F.col("predicted")).alias("residual"))
    return rounded(M.qq_points(r, "residual"))


# ---- charts ---------------------------------------------------------------------

@register("chart_histogram_price", sql_rounded(_hist_sql("select * from orders", "o_totalprice"), ["lo", "hi"]))
def q_hist(spark, sf):
    return rounded(C.histogram(read_table(spark, sf, "orders"), "o_totalprice"))


@register("chart_box_price_by_priority", sql_rounded("""
with d as (select cast(o_orderpriority as varchar) as "group", o_totalprice as v from orders where o_totalprice is not null),
q as (select "group", count(*) as n, quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.5) as median,
      quantile_cont(v, 0.75) as q3 from d group by 1)
select q."group", cast(q.n as bigint) as n, q.q1, q.median, q.q3,
  min(case when v >= q1 - 1.5 * (q3 - q1) then v end) as whisker_low,
  max(case when v <= q3 + 1.5 * (q3 - q1) then v end) as whisker_high,
  cast(count_if(v < q1 - 1.5 * (q3 - q1) or v > q3 + 1.5 * (q3 - q1)) as bigint) as fliers
from d join q on d."group" = q."group" group by q."group", q.n, q.q1, q.median, q.q3""",
                                                     ["q1", "median", "q3", "whisker_low", "whisker_high"]))
def q_box(spark, sf):
    return rounded(C.box_stats(read_table(spark, sf, "orders"), "o_totalprice", "o_orderpriority"))


@register("chart_line_means", sql_rounded("""
select l_linenumber as x, avg(l_extendedprice) as mean, cast(count(*) as bigint) as n from lineitem
where l_linenumber is not null and l_extendedprice is not null group by 1""", ["mean"]))
def q_line(spark, sf):
    return rounded(C.line_means(read_table(spark, sf, "lineitem"), "l_linenumber", "l_extendedprice"))


@register("chart_bar_counts", """
with g as (select cast(p_name as varchar) as value, count(*) as count from part where p_name is not null group by 1),
k as (select value from g order by count desc, value limit 10)
select case when (select count(*) from g) <= 50 or value in (select value from k) then value else 'Other' end as value,
  cast(sum(count) as bigint) as count from g group by 1""")
def q_bar(spark, sf):
    return C.bar_counts(read_table(spark, sf, "part"), "p_name")


@register("chart_pie_shares", sql_rounded("""
with g as (select cast(o_orderpriority as varchar) as value, count(*) as count from orders
           where o_orderpriority is not null group by 1)
select value, cast(count as bigint) as count, count / (select sum(count) from g) as share from g""", ["share"]))
def q_pie(spark, sf):
    return rounded(C.pie_shares(read_table(spark, sf, "orders"), "o_orderpriority"))


@register("chart_text_lengths", sql_rounded(_hist_sql(
    "select case when text is null then null when trim(text) = '' then 0 "
    "else len(string_split_regex(trim(text), '\\s+')) end as words from documents", "words"), ["lo", "hi"]))
def q_text_len(spark, sf):
    return rounded(C.text_lengths(read_table(spark, sf, "documents"), "text"))


@register("chart_scatter_sample", """
select o_orderkey, o_totalprice from orders order by md5(concat_ws('|', '42', cast(o_orderkey as varchar))) limit 5000""")
def q_scatter(spark, sf):
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return C.sample_rows(o, "o_orderkey", 5000, 42)


@register("chart_kde_price", sql_rounded(f"""
with v as (select cast(o_totalprice as double) as v from orders where o_totalprice is not null),
s as (select count(*) as n, stddev_samp(v) * power(count(*), -0.2) as h, min(v) as lo, max(v) as hi from v),
b as (select floor((v - lo) / (h / {C.KDE_STEPS})) as bin, count(*) as k, avg(v) as v from v, s group by 1),
g as (select (lo - 3 * h) + ((hi + 3 * h) - (lo - 3 * h)) * i / {C.KDE_POINTS - 1} as x from s, range({C.KDE_POINTS}) r(i))
select x, sum(k * exp(-0.5 * power((x - v) / h, 2))) / any_value(n * h * sqrt(2 * pi())) as density from g, b, s group by x""", ["x", "density"], 8))
def q_kde(spark, sf):
    return rounded(C.kde(read_table(spark, sf, "orders"), "o_totalprice", "o_orderkey"), 8)


@register("chart_missing_map", f"""with src as ({DIRTY_ORDERS_SQL}),
s as (select * from src order by md5(concat_ws('|', '42', cast(row_id as varchar))) limit 200)
select cast(row_id as varchar) as row_key, 'segment' as "column",
  segment is null or regexp_matches(segment, '^\\s*$') as missing from s""")
def q_missing_map(spark, sf):
    return C.missing_map(dirty_orders(spark, sf), "row_id", 200)
