"""Registered queries: statistics (STA-*) on the survey fixture (lineitem).

The oracle checks the distributed part — statistic, degrees of freedom,
effect size, coefficients; p-values are checked against published R output
in tests/test_stats.py.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats as S
from .fixtures import SURVEY_SQL, survey
from .registry import register, rounded, sql_rounded

SV = f"sv as ({SURVEY_SQL})"


def _moments_sql(y, g, where="true"):
    return (f"m as (select cast({g} as varchar) as g, count(*) as n, avg({y}) as mean, var_samp({y}) as var "
            f"from sv where {y} is not null and {g} is not null and {where} group by 1)")


@register("stat_welch_t", sql_rounded(f"""with {SV}, {_moments_sql('pre', 'status')},
a as (select * from m order by g limit 1), b as (select * from m order by g offset 1 limit 1)
select (a.mean - b.mean) / sqrt(a.var / a.n + b.var / b.n) as statistic,
  power(a.var / a.n + b.var / b.n, 2) / (power(a.var / a.n, 2) / (a.n - 1) + power(b.var / b.n, 2) / (b.n - 1)) as df,
  (a.mean - b.mean) / sqrt(((a.n - 1) * a.var + (b.n - 1) * b.var) / (a.n + b.n - 2)) as effect_value
from a, b""", ["statistic", "df", "effect_value"]))
def q_welch(spark, sf):
    return rounded(S.compare_groups(survey(spark, sf), "pre", "status", "welch_t")
                   .select("statistic", "df", "effect_value"))


@register("stat_student_t", sql_rounded(f"""with {SV}, {_moments_sql('pre', 'status')},
a as (select * from m order by g limit 1), b as (select * from m order by g offset 1 limit 1),
s as (select sqrt(((a.n - 1) * a.var + (b.n - 1) * b.var) / (a.n + b.n - 2)) as sp, a.mean - b.mean as diff,
  a.n as na, b.n as nb from a, b)
select diff / (sp * sqrt(1.0 / na + 1.0 / nb)) as statistic, cast(na + nb - 2 as double) as df, diff / sp as effect_value
from s""", ["statistic", "df", "effect_value"]))
def q_student(spark, sf):
    return rounded(S.compare_groups(survey(spark, sf), "pre", "status", "student_t")
                   .select("statistic", "df", "effect_value"))


ANOVA_SQL = f"""with {SV}, {_moments_sql('pre', 'grp')},
t as (select sum(n) as n, count(*) as k, sum(n * mean) / sum(n) as grand from m),
ss as (select sum(m.n * power(m.mean - t.grand, 2)) as ssb, sum((m.n - 1) * m.var) as ssw, max(t.n) as n, max(t.k) as k
       from m, t)"""


@register("stat_anova", sql_rounded(ANOVA_SQL + """
select (ssb / (k - 1)) / (ssw / (n - k)) as statistic, cast(k - 1 as double) as df, cast(n - k as double) as df2,
  ssb / (ssb + ssw) as effect_value from ss""", ["statistic", "df", "df2", "effect_value"]))
def q_anova(spark, sf):
    return rounded(S.compare_groups(survey(spark, sf), "pre", "grp", "anova")
                   .select("statistic", "df", "df2", "effect_value"))


@register("stat_welch_anova", sql_rounded(f"""with {SV}, {_moments_sql('pre', 'grp')},
w as (select *, n / var as w from m), sw as (select sum(w) as sw, sum(w * mean) / sum(w) as mw, count(*) as k from w),
parts as (select sum(w.w * power(w.mean - sw.mw, 2)) / (max(sw.k) - 1) as a_,
  sum(power(1 - w.w / sw.sw, 2) / (w.n - 1)) as tmp, max(sw.k) as k from w, sw)
select a_ / (1 + 2 * (k - 2) / (k * k - 1.0) * tmp) as statistic, cast(k - 1 as double) as df,
  (k * k - 1.0) / (3 * tmp) as df2 from parts""", ["statistic", "df", "df2"]))
def q_welch_anova(spark, sf):
    return rounded(S.compare_groups(survey(spark, sf), "pre", "grp", "welch_anova")
                   .select("statistic", "df", "df2"))


RANKS_SQL = f"""with {SV}, d as (select cast(grp as varchar) as g, pre as y from sv where pre is not null and grp is not null),
r as (select g, y, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0 as rk from d),
sums as (select g, sum(rk) as R, count(*) as n from r group by g),
ties as (select sum(power(c, 3) - c) as TT, sum(c) as NN from (select count(*) as c from d group by y))"""


@register("stat_kruskal", sql_rounded(RANKS_SQL + """
, h as (select (12.0 / (max(NN) * (max(NN) + 1)) * sum(R * R / n) - 3 * (max(NN) + 1)) / (1 - max(TT) / (power(max(NN), 3) - max(NN)))
  as H, count(*) as k, max(NN) as NN from sums, ties)
select H as statistic, cast(k - 1 as double) as df, H / (NN - 1) as effect_value from h""",
                                   ["statistic", "df", "effect_value"]))
def q_kruskal(spark, sf):
    return rounded(S.compare_groups(survey(spark, sf), "pre", "grp", "kruskal")
                   .select("statistic", "df", "effect_value"))


@register("stat_mann_whitney", sql_rounded(f"""with {SV}, d as (select cast(status as varchar) as g, pre as y from sv
  where pre is not null and status is not null),
r as (select g, y, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0 as rk from d),
sums as (select g, sum(rk) as R, count(*) as n from r group by g),
a as (select * from sums order by g limit 1), b as (select * from sums order by g offset 1 limit 1),
u as (select a.R - a.n * (a.n + 1) / 2.0 as u1, a.n as na, b.n as nb from a, b)
select u1 as statistic, 2 * u1 / (na * nb) - 1 as effect_value from u""", ["statistic", "effect_value"]))
def q_mann_whitney(spark, sf):
    return rounded(S.compare_groups(survey(spark, sf), "pre", "status", "mann_whitney")
                   .select("statistic", "effect_value"))


@register("stat_levene", sql_rounded(f"""with {SV}, d as (select cast(grp as varchar) as g, pre as y from sv
  where pre is not null and grp is not null),
med as (select g, quantile_cont(y, 0.5) as md from d group by g),
z as (select d.g, abs(d.y - med.md) as z from d join med on d.g = med.g),
m as (select g, count(*) as n, avg(z) as mean, var_samp(z) as var from z group by g),
t as (select sum(n) as n, count(*) as k, sum(n * mean) / sum(n) as grand from m),
ss as (select sum(m.n * power(m.mean - t.grand, 2)) as ssb, sum((m.n - 1) * m.var) as ssw, max(t.n) as n, max(t.k) as k
       from m, t)
select (ssb / (k - 1)) / (ssw / (n - k)) as f, cast(k - 1 as bigint) as df1, cast(n - k as bigint) as df2 from ss""",
                                   ["f"]))
def q_levene(spark, sf):
    d = survey(spark, sf).select(F.col("pre").alias("y"), F.col("grp").cast("string").alias("g")).dropna()
    f, _p, df1, df2 = S.levene(d)
    return rounded(spark.createDataFrame([(float(f), int(df1), int(df2))], "f double, df1 long, df2 long"))


@register("stat_tukey", sql_rounded(f"""with {SV}, {_moments_sql('pre', 'grp')},
t as (select sum((n - 1) * var) / (sum(n) - count(*)) as mse from m)
select a.g as a, b.g as b, a.mean - b.mean as difference,
  abs(a.mean - b.mean) / sqrt(t.mse / 2 * (1.0 / a.n + 1.0 / b.n)) as q
from m a join m b on a.g < b.g, t""", ["difference", "q"]))
def q_tukey(spark, sf):
    return rounded(S.tukey_hsd(survey(spark, sf), "pre", "grp").select("a", "b", "difference", "q"))


@register("stat_paired_t", sql_rounded(f"""with {SV}, d as (select pre - post as d from sv where pre - post is not null),
s as (select count(*) as n, avg(d) as mean, stddev_samp(d) as sd from d)
select mean / (sd / sqrt(n)) as statistic, cast(n - 1 as double) as df, mean / sd as effect_value from s""",
                                      ["statistic", "df", "effect_value"]))
def q_paired_t(spark, sf):
    return rounded(S.paired(survey(spark, sf), "pre", "post", "paired_t").select("statistic", "df", "effect_value"))


@register("stat_wilcoxon", sql_rounded(f"""with {SV}, d as (select q1 - q2 as d from sv where q1 - q2 is not null and q1 - q2 <> 0),
r as (select d, rank() over (order by abs(d)) + (count(*) over (partition by abs(d)) - 1) / 2.0 as rk from d)
select sum(case when d > 0 then rk else 0 end) as statistic,
  (sum(case when d > 0 then rk else 0 end) - sum(case when d < 0 then rk else 0 end)) / sum(rk) as effect_value
from r""", ["statistic", "effect_value"]))
def q_wilcoxon(spark, sf):
    return rounded(S.paired(survey(spark, sf), "q1", "q2", "wilcoxon").select("statistic", "effect_value"))


_CORR = ["quantity", "pre", "discount"]


def _corr_sql(method):
    parts = []
    for i, a in enumerate(_CORR):
        for b in _CORR[i + 1:]:
            if method == "pearson":
                parts.append(f"""select '{a}' as a, '{b}' as b, cast(count(*) as bigint) as n, corr({a}, {b}) as r,
  tanh(atanh(corr({a}, {b})) - 1.959963984540054 / sqrt(count(*) - 3)) as ci_low,
  tanh(atanh(corr({a}, {b})) + 1.959963984540054 / sqrt(count(*) - 3)) as ci_high
from sv where {a} is not null and {b} is not null""")
            else:
                parts.append(f"""select '{a}' as a, '{b}' as b, cast(count(*) as bigint) as n, corr(ra, rb) as r from (
  select rank() over (order by {a}) + (count(*) over (partition by {a}) - 1) / 2.0 as ra,
         rank() over (order by {b}) + (count(*) over (partition by {b}) - 1) / 2.0 as rb
  from sv where {a} is not null and {b} is not null)""")
    cols = ["r", "ci_low", "ci_high"] if method == "pearson" else ["r"]
    return sql_rounded(f"with {SV} " + " union all ".join(parts), cols)


@register("stat_pearson", _corr_sql("pearson"))
def q_pearson(spark, sf):
    return rounded(S.correlation(survey(spark, sf), _CORR, "pearson").select("a", "b", "n", "r", "ci_low", "ci_high"))


@register("stat_spearman", _corr_sql("spearman"))
def q_spearman(spark, sf):
    return rounded(S.correlation(survey(spark, sf), _CORR, "spearman").select("a", "b", "n", "r"))


@register("stat_chi2", sql_rounded(f"""with {SV},
o as (select cast(grp as varchar) as r, cast(q1 as varchar) as c, count(*) as o from sv
      where grp is not null and q1 is not null group by 1, 2),
rt as (select r, sum(o) as rt from o group by r), ct as (select c, sum(o) as ct from o group by c),
n as (select sum(o) as n from o),
cells as (select rt.r, ct.c, coalesce(o.o, 0) as o, rt.rt * ct.ct / n.n as e from rt cross join ct cross join n
          left join o on o.r = rt.r and o.c = ct.c),
k as (select count(distinct r) as nr, count(distinct c) as nc, sum(o) as n from cells)
select sum(power(o - e, 2) / e) as statistic, cast(max((nr - 1) * (nc - 1)) as double) as df,
  sqrt(sum(power(o - e, 2) / e) / (max(n) * (least(max(nr), max(nc)) - 1))) as effect_value
from cells, k""", ["statistic", "df", "effect_value"]))
def q_chi2(spark, sf):
    return rounded(S.association(survey(spark, sf), "grp", "q1").select("statistic", "df", "effect_value"))


@register("stat_fisher_odds", sql_rounded(f"""with {SV},
t as (select cast(status as varchar) as r, case when discount > 0.05 then 'high' else 'low' end as c from sv),
o as (select r, c, count(*) as o from t group by 1, 2),
x as (select max(case when r = 'F' and c = 'high' then o end) as a, max(case when r = 'F' and c = 'low' then o end) as b,
             max(case when r = 'O' and c = 'high' then o end) as c_, max(case when r = 'O' and c = 'low' then o end) as d
      from o)
select cast(a * d as double) / (b * c_) as odds_ratio from x""", ["odds_ratio"]))
def q_fisher(spark, sf):
    s = survey(spark, sf).withColumn("level", F.when(F.col("discount") > 0.05, "high").otherwise("low"))
    return rounded(S.fisher_exact(s, "status", "level").select("odds_ratio"))


@register("stat_ols_simple", sql_rounded(f"""with {SV}
select '(Intercept)' as term, regr_intercept(pre, quantity) as estimate from sv where pre is not null and quantity is not null
union all select 'quantity', regr_slope(pre, quantity) from sv where pre is not null and quantity is not null""",
                                         ["estimate"]))
def q_ols_simple(spark, sf):
    coef, _ = S.ols(survey(spark, sf), "pre", ["quantity"])
    return rounded(coef.select("term", "estimate"))


@register("stat_ols_r2", sql_rounded(f"""with {SV}
select cast(regr_count(pre, quantity) as bigint) as n, regr_r2(pre, quantity) as r2 from sv""", ["r2"]))
def q_ols_r2(spark, sf):
    _, summ = S.ols(survey(spark, sf), "pre", ["quantity"])
    return rounded(summ.select("n", "r2"))


@register("stat_ols_multi")
def q_ols_multi(spark, sf):
    coef, _ = S.ols(survey(spark, sf), "pre", ["quantity", "discount", "tax", "grp"])
    return rounded(coef)


@register("stat_vif_two", sql_rounded(f"""with {SV}, r as (select corr(quantity, discount) as r from sv
  where quantity is not null and discount is not null)
select 'quantity' as term, 1 / (1 - r * r) as vif, 1 / (1 - r * r) > 10 as high from r
union all select 'discount', 1 / (1 - r * r), 1 / (1 - r * r) > 10 from r""", ["vif"]))
def q_vif(spark, sf):
    return rounded(S.vif(survey(spark, sf), ["quantity", "discount"]))


@register("stat_logistic")
def q_logistic(spark, sf):
    s = survey(spark, sf).withColumn("returned", (F.col("grp") == "R").cast("int"))
    return rounded(S.logistic(s, "returned", ["quantity", "discount"]))


@register("stat_cronbach", sql_rounded(f"""with {SV},
it as (select q1, q2, q3, 1 + 5 - q4 as q4 from sv where q1 is not null and q2 is not null and q3 is not null
       and q4 is not null),
v as (select var_samp(q1) + var_samp(q2) + var_samp(q3) + var_samp(q4) as sv, var_samp(q1 + q2 + q3 + q4) as tv,
  (corr(q1, q2) + corr(q1, q3) + corr(q1, q4) + corr(q2, q3) + corr(q2, q4) + corr(q3, q4)) / 6 as rm,
  count(*) as n from it)
select 4.0 / 3 * (1 - sv / tv) as alpha, 4 * rm / (1 + 3 * rm) as standardized_alpha, cast(n as bigint) as n,
  rm as mean_inter_item_r from v""", ["alpha", "standardized_alpha", "mean_inter_item_r"]))
def q_cronbach(spark, sf):
    summ, _ = S.reliability(survey(spark, sf), ["q1", "q2", "q3", "q4"], reverse=["q4"])
    return rounded(summ.select("alpha", "standardized_alpha", "n", "mean_inter_item_r"))


def _items_sql():
    items = ["q1", "q2", "q3", "q4"]
    parts = []
    for c in items:
        rest = [o for o in items if o != c]
        total, spread = " + ".join(rest), " + ".join(f"var_samp({o})" for o in rest)
        parts.append(f"select '{c}' as item, {str(c == 'q4').lower()} as reversed, avg({c}) as mean, stddev_samp({c}) as sd, "
                     f"corr({c}, {total}) as item_total_r, 1.5 * (1 - ({spread}) / var_samp({total})) as alpha_if_deleted from it")
    return f"""with {SV}, it as (select q1, q2, q3, 1 + 5 - q4 as q4 from sv
where q1 is not null and q2 is not null and q3 is not null and q4 is not null) {' union all '.join(parts)}"""


@register("stat_cronbach_items", sql_rounded(_items_sql(), ["mean", "sd", "item_total_r", "alpha_if_deleted"]))
def q_cronbach_items(spark, sf):
    _, items = S.reliability(survey(spark, sf), ["q1", "q2", "q3", "q4"], reverse=["q4"])
    return rounded(items)


def _likert_sql():
    cols = ["okey", "line", "q1", "q2", "q3", "q4", "pre", "post", "quantity", "discount", "tax"]
    parts = [f"""select '{c}' as column, min(cast({c} as double)) as min, max(cast({c} as double)) as max,
  cast(count(distinct {c}) as bigint) as levels, coalesce(bool_and(cast({c} as double) % 1 = 0), false) as whole,
  count({c}) as n from sv""" for c in cols]
    return f"""with {SV}, f as ({' union all '.join(parts)})
select "column", min, max, levels, printf('%.0f', min) || '-' || printf('%.0f', max) as range
from f where n > 0 and whole and levels between 3 and 11 and min >= 0 and max <= 10"""


@register("stat_likert", sql_rounded(_likert_sql(), ["min", "max"]))
def q_likert(spark, sf):
    return rounded(S.likert_candidates(survey(spark, sf)))


@register("stat_shapiro_by_group")
def q_shapiro(spark, sf):
    d = survey(spark, sf).select(F.col("pre").alias("y"), F.col("grp").alias("g")).dropna()
    return rounded(S.shapiro_by_group(d))


@register("stat_compare_auto")
def q_compare_auto(spark, sf):
    return rounded(S.compare_groups(survey(spark, sf), "pre", "grp", "auto"))


@register("stat_paired_auto")
def q_paired_auto(spark, sf):
    return rounded(S.paired(survey(spark, sf), "pre", "post", "auto"))


@register("stat_association")
def q_association(spark, sf):
    return rounded(S.association(survey(spark, sf), "grp", "status"))
