"""Registered queries: profiles and descriptive aggregates (AGG-*, SRC-06)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as P
from ..sources.tables import inf_report, read_table
from .fixtures import DIRTY_ORDERS_SQL, SURVEY_SQL, dirty_orders, survey
from .registry import register, rounded, sql_rounded

DIRTY_COLS = [("row_id", "bigint", True), ("segment", "string", False), ("amount_text", "string", False),
              ("balance", "double", True), ("day_text", "string", False), ("priority", "string", False),
              ("price", "double", True), ("constant_col", "int", True)]


def _profile_sql() -> str:
    parts = []
    for c, t, num in DIRTY_COLS:
        miss = f"count_if({c} is null)" if num else f"count_if({c} is null or regexp_matches({c}, '^\\s*$'))"
        if num:
            x = f"cast({c} as double)"
            stats = (f"min({x}) as min, max({x}) as max, avg({x}) as mean, quantile_cont({x}, 0.5) as median, "
                     f"stddev_samp({x}) as std, quantile_cont({x}, 0.25) as q1, quantile_cont({x}, 0.75) as q3, "
                     f"case when count({x}) < 3 then null when var_pop({x}) = 0 then 0 else skewness({x}) end as skew, "
                     f"case when count({x}) < 4 then null when var_pop({x}) = 0 then 0 else kurtosis({x}) end as kurtosis")
        else:
            stats = ", ".join(f"cast(null as double) as {s}" for s in
                              ("min", "max", "mean", "median", "std", "q1", "q3", "skew", "kurtosis"))
        parts.append(f"select '{c}' as column, '{t}' as data_type, cast({miss} as bigint) as missing, "
                     f"round_even({miss} * 100.0 / count(*), 2) as missing_pct, "
                     f"cast(count(distinct {c}) as bigint) as n_distinct, count(distinct {c}) <= 1 as is_constant, "
                     f"{stats} from dirty")
    body = " union all ".join(parts)
    inner = f"with dirty as ({DIRTY_ORDERS_SQL}) {body}"
    return sql_rounded(inner, ["missing_pct", "min", "max", "mean", "median", "std", "q1", "q3", "skew", "kurtosis"])


@register("profile_columns", _profile_sql())
def q_profile_columns(spark, sf):
    return rounded(P.profile(dirty_orders(spark, sf)))


@register("profile_dataset", f"""
with dirty as ({DIRTY_ORDERS_SQL}), g as (select count(*) as n from dirty group by all_cols)
select 1""".replace("group by all_cols", "group by row_id, segment, amount_text, balance, day_text, priority, price, constant_col")
          .replace("select 1", "select cast(sum(n) as bigint) as rows, cast(8 as bigint) as columns, cast(sum(n - 1) as bigint) as duplicate_rows from g"))
def q_profile_dataset(spark, sf):
    return P.dataset_summary(dirty_orders(spark, sf))


@register("profile_lineitem_duplicates", """
with g as (select count(*) as n from lineitem
  group by l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus)
select cast(sum(n) as bigint) as rows, cast(5 as bigint) as columns, cast(sum(n - 1) as bigint) as duplicate_rows from g""")
def q_profile_lineitem_duplicates(spark, sf):
    li = read_table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_quantity", "l_returnflag",
                                                  "l_linestatus")
    return P.dataset_summary(li)


@register("profile_approx")
def q_profile_approx(spark, sf):
    """AGG-19: same shape with approximate distinct counts and quantiles."""
    return rounded(P.profile(dirty_orders(spark, sf), approx=True))


@register("top_values_segment", sql_rounded(f"""
with dirty as ({DIRTY_ORDERS_SQL}),
g as (select cast(segment as varchar) as value, count(*) as count from dirty where segment is not null group by 1),
t as (select count(*) as total from dirty)
select cast(row_number() over (order by count desc, value) as integer) as rank, value, cast(count as bigint) as count,
  round_even(count * 100.0 / total, 2) as percent
from g, t order by count desc, value limit 10""", ["percent"]))
def q_top_values(spark, sf):
    return rounded(P.top_values(dirty_orders(spark, sf), "segment", 10))


@register("frequencies_priority", sql_rounded("""
with g as (select cast(o_orderpriority as varchar) as value, count(*) as count from orders
           where o_orderpriority is not null group by 1 order by count desc, value limit 50),
t as (select count(*) as total, count(o_orderpriority) as valid from orders)
select value, cast(count as bigint) as count, count * 100.0 / total as percent, count * 100.0 / valid as valid_percent,
  sum(count) over (order by count desc, value rows between unbounded preceding and current row) * 100.0 / valid
    as cumulative_percent
from g, t""", ["percent", "valid_percent", "cumulative_percent"]))
def q_frequencies(spark, sf):
    return rounded(P.frequencies(read_table(spark, sf, "orders"), "o_orderpriority", 50))


_DESC_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _describe_sql():
    parts = []
    for c in _DESC_COLS:
        x = f"cast({c} as double)"
        parts.append(f"""select '{c}' as column, cast(count({x}) as bigint) as n,
  cast(count(*) - count({x}) as bigint) as missing, avg({x}) as mean, quantile_cont({x}, 0.5) as median,
  (select min(v) from (select {c} as v, count(*) as k from lineitem where {c} is not null group by 1) m
     where k = (select max(k2) from (select count(*) as k2 from lineitem where {c} is not null group by {c}))) as mode,
  (select cast(count(*) as bigint) from (select {c} as v, count(*) as k from lineitem where {c} is not null group by 1) m
     where k = (select max(k2) from (select count(*) as k2 from lineitem where {c} is not null group by {c}))) as n_modes,
  min({x}) as min, max({x}) as max, max({x}) - min({x}) as range, var_samp({x}) as var, stddev_samp({x}) as sd,
  stddev_samp({x}) / sqrt(count({x})) as se, quantile_cont({x}, 0.25) as q1, quantile_cont({x}, 0.75) as q3,
  quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25) as iqr,
  case when count({x}) < 3 then null when var_pop({x}) = 0 then 0 else skewness({x}) end as skew,
  case when count({x}) < 4 then null when var_pop({x}) = 0 then 0 else kurtosis({x}) end as kurtosis
from lineitem""")
    return sql_rounded(" union all ".join(parts), ["mean", "median", "mode", "min", "max", "range", "var", "sd", "se",
                                                   "q1", "q3", "iqr", "skew", "kurtosis"])


@register("describe_lineitem", _describe_sql())
def q_describe(spark, sf):
    return rounded(P.describe(read_table(spark, sf, "lineitem"), _DESC_COLS))


@register("group_summary_price_by_flag", sql_rounded("""
select cast(l_returnflag as varchar) as "group", cast(count(*) as bigint) as n, avg(l_extendedprice) as mean,
  stddev_samp(l_extendedprice) as sd, quantile_cont(l_extendedprice, 0.5) as median
from lineitem where l_extendedprice is not null and l_returnflag is not null group by 1""",
                                                     ["mean", "sd", "median"]))
def q_group_summary(spark, sf):
    return rounded(P.group_summary(read_table(spark, sf, "lineitem"), "l_extendedprice", "l_returnflag"))


@register("crosstab_flag_status", sql_rounded("""
with o as (select cast(l_returnflag as varchar) as r, cast(l_linestatus as varchar) as c, count(*) as observed
           from lineitem where l_returnflag is not null and l_linestatus is not null group by 1, 2),
rt as (select r, sum(observed) as rt from o group by r), ct as (select c, sum(observed) as ct from o group by c),
n as (select sum(observed) as n from o)
select rt.r as "row", ct.c as col, cast(coalesce(o.observed, 0) as bigint) as observed, rt.rt * ct.ct / n.n as expected
from rt cross join ct cross join n left join o on o.r = rt.r and o.c = ct.c""", ["expected"]))
def q_crosstab(spark, sf):
    return rounded(P.crosstab(read_table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus"))


_CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _corr_sql():
    parts = []
    for i, a in enumerate(_CORR_COLS):
        for b in _CORR_COLS[i + 1:]:
            parts.append(f"select '{a}' as col_a, '{b}' as col_b, corr(cast({a} as double), cast({b} as double)) as r "
                         f"from lineitem")
    return sql_rounded(" union all ".join(parts), ["r"])


@register("correlation_matrix_lineitem", _corr_sql())
def q_corr(spark, sf):
    return rounded(P.correlation_matrix(read_table(spark, sf, "lineitem"), _CORR_COLS))


@register("class_counts_event_type", sql_rounded("""
with g as (select cast(event_type as varchar) as class, count(*) as count from events
           where event_type is not null group by 1), t as (select sum(count) as total from g)
select class, cast(count as bigint) as count, count / total as share, count / total < 0.2 as is_minority from g, t""",
                                                 ["share"]))
def q_class_counts(spark, sf):
    return rounded(P.class_counts(read_table(spark, sf, "events"), "event_type"))


@register("facts_lineitem", """
select cast(count(*) as bigint) as rows, cast(3 as bigint) as features,
  bool_or(l_quantity is null or l_discount is null or l_tax is null) as any_null,
  coalesce(bool_or(least(l_quantity, l_discount, l_tax) < 0), false) as any_negative,
  coalesce(bool_or(l_linenumber = 0), false) as target_has_zero
from lineitem""")
def q_facts(spark, sf):
    return P.facts(read_table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_linenumber")


@register("examples_part_type", """
select value from (select distinct cast(p_type as varchar) as value from part where p_type is not null)
order by value limit 8""")
def q_examples(spark, sf):
    return P.examples(read_table(spark, sf, "part"), "p_type", 8)


@register("inf_report_survey", """
select 'pre' as column, cast(count_if(isnan(l_extendedprice) or isinf(l_extendedprice)) as bigint) as n_inf from lineitem
union all select 'post', cast(count_if(isnan(l_extendedprice*(1-l_discount)) or isinf(l_extendedprice*(1-l_discount))) as bigint) from lineitem
union all select 'quantity', cast(count_if(isnan(l_quantity) or isinf(l_quantity)) as bigint) from lineitem
union all select 'discount', cast(count_if(isnan(l_discount) or isinf(l_discount)) as bigint) from lineitem
union all select 'tax', cast(count_if(isnan(l_tax) or isinf(l_tax)) as bigint) from lineitem""")
def q_inf_report(spark, sf):
    return inf_report(survey(spark, sf))


_ = (F, SURVEY_SQL)
