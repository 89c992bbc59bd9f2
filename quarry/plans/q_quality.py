"""Registered queries: data-quality checks (DQ-*) on the dirty-orders and
contacts fixtures. The DuckDB twin builds the same per-column facts table."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions.text import DATE_RE, EMAIL_RE, PHONE_RE, YEAR_RE
from ..operators import quality as Q
from .fixtures import CONTACTS_SQL, DIRTY_ORDERS_SQL, contacts, dirty_orders
from .q_profile import DIRTY_COLS
from .registry import ORACLES, register as _register, rounded, sql_rounded


def register(name, sql=None):
    """Quote the ``column`` identifier (a DuckDB keyword) in the oracle SQL."""
    return _register(name, re.sub(r'(?<![\'"])\bcolumn\b(?![\'"])', '"column"', sql) if sql else None)

CONTACT_COLS = [("row_id", "bigint", True), ("name", "string", False), ("email", "string", False),
                ("phone", "string", False), ("segment", "string", False)]


def facts_sql(src_sql: str, cols) -> str:
    """DuckDB version of quality.column_facts for the given (name, type, numeric) list."""
    parts = []
    for c, _t, num in cols:
        kind = "numeric" if num else "text"
        s = f"cast({c} as varchar)"
        t = f"trim({s})"
        nonblank = f"({c} is not null and not regexp_matches({s}, '^\\s*$'))"
        if num:
            x = f"cast({c} as double)"
            numeric = (f"min({x}) as min, max({x}) as max, coalesce(bool_and({x} % 1 = 0), false) as all_whole, "
                       f"count_if({x} < 0) as negatives, count_if({x} = 0) as zeros, 0 as numeric_text, "
                       f"0 as whitespace, 0 as emails, 0 as phones, 0 as date_like, 0 as year_like, 0 as nonblank, "
                       f"cast(null as double) as median_words, 0 as blanks")
        else:
            numeric = (
                "cast(null as double) as min, cast(null as double) as max, false as all_whole, 0 as negatives, "
                f"0 as zeros, count_if({c} is not null and try_cast(replace({t}, ',', '') as double) is not null) "
                f"as numeric_text, count_if({c} is not null and {s} <> {t}) as whitespace, "
                f"count_if({nonblank} and regexp_matches({t}, '{EMAIL_RE}')) as emails, "
                f"count_if({nonblank} and regexp_matches({t}, '{PHONE_RE}') and "
                f"length(regexp_replace({t}, '\\D', '', 'g')) between 7 and 15 and "
                f"regexp_matches({t}, '[+ ()\\-.]')) as phones, "
                f"count_if({c} is not null and regexp_matches({t}, '{DATE_RE}')) as date_like, "
                f"count_if({c} is not null and regexp_matches({s}, '{YEAR_RE}')) as year_like, "
                f"count_if({nonblank}) as nonblank, "
                f"quantile_cont(case when {c} is null then null when {t} = '' then 0 "
                f"else len(string_split_regex({t}, '\\s+')) end, 0.5) as median_words, "
                f"count_if({c} is not null and regexp_matches({s}, '^\\s*$')) as blanks")
        pairs = "[['no','yes'],['false','true'],['f','t'],['n','y'],['0','1']]"
        boolpair = (f"(select count(*) = 2 and list_contains({pairs}, list_sort(list(v))) from "
                    f"(select distinct lower(trim(cast({c} as varchar))) as v from src where {c} is not null))")
        parts.append(f"select '{c}' as column, '{kind}' as kind, count(*) as rows, count_if({c} is null) as nulls, "
                     f"count(*) - count_if({c} is null) as non_null, count(distinct {c}) as n_distinct, {numeric}, "
                     f"{boolpair} as is_bool_pair from src")
    return f"src as ({src_sql}), facts as ({' union all '.join(parts)})"


DIRTY_FACTS = facts_sql(DIRTY_ORDERS_SQL, DIRTY_COLS)
CONTACT_FACTS = facts_sql(CONTACTS_SQL, CONTACT_COLS)

LOOKS_DATE = ("(kind = 'text' and non_null > 0 and date_like >= 0.8 * non_null and year_like >= 0.8 * non_null)")
TEXT_KIND = ("(case when non_null > 0 and n_distinct / greatest(non_null, 1) >= 0.5 and median_words >= 3 "
             "then 'free_text' else 'string' end)")


@register("dq_missing", sql_rounded(f"""with {DIRTY_FACTS}
select column, cast(nulls + blanks as bigint) as missing_count, round_even((nulls + blanks) * 100.0 / rows, 2)
  as missing_percent, cast(nulls as bigint) as null_count, cast(blanks as bigint) as empty_string_count
from facts where nulls + blanks > 0""", ["missing_percent"]))
def q_dq_missing(spark, sf):
    return rounded(Q.detect_missing(Q.column_facts(dirty_orders(spark, sf))))


def _miss_expr(cols):
    return " + ".join((f"cast({c} is null as int)" if num else
                       f"cast({c} is null or regexp_matches({c}, '^\\s*$') as int)") for c, _t, num in cols)


@register("dq_rows_with_missing", f"""with src as ({DIRTY_ORDERS_SQL}), k as (select {_miss_expr(DIRTY_COLS)} as k from src)
select cast(count(*) as bigint) as total_rows, cast(sum(k) as bigint) as total_missing_cells,
  cast(count_if(k > 0) as bigint) as rows_with_missing from k""")
def q_dq_rows_missing(spark, sf):
    return Q.rows_with_missing(dirty_orders(spark, sf))


@register("dq_duplicates", sql_rounded(f"""with src as ({DIRTY_ORDERS_SQL}),
g as (select count(*) as n from src group by segment, priority, constant_col)
select cast(sum(n) as bigint) as total_rows, cast(sum(n - 1) as bigint) as duplicate_rows,
  round_even(sum(n - 1) * 100.0 / sum(n), 2) as duplicate_percent,
  cast(sum(case when n > 1 then n else 0 end) as bigint) as rows_involved,
  cast(sum(n) - sum(n - 1) as bigint) as unique_rows from g""", ["duplicate_percent"]))
def q_dq_duplicates(spark, sf):
    return rounded(Q.detect_duplicates(dirty_orders(spark, sf), ["segment", "priority", "constant_col"]))


@register("dq_duplicate_groups", """
with src as (select o_orderkey as k, o_orderstatus as s, o_orderpriority as p from orders),
g as (select s, p, count(*) as copies, min(k) as first_key from src group by s, p having count(*) > 1
      order by first_key limit 20)
select cast(g.first_key as bigint) as first_key, cast(g.copies as bigint) as copies,
  array_to_string(list(cast(src.k as varchar) order by src.k), ',') as row_keys
from g join src on src.s = g.s and src.p = g.p group by g.first_key, g.copies""")
def q_dq_duplicate_groups(spark, sf):
    from ..sources.tables import read_table
    o = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"),
                                               F.col("o_orderpriority").alias("p"))
    return Q.duplicate_groups(o, "k", 20)


@register("dq_outliers", sql_rounded(f"""with src as ({DIRTY_ORDERS_SQL}),
b as (select 'row_id' as column, cast(row_id as double) as v from src union all select 'balance', balance from src
      union all select 'price', price from src union all select 'constant_col', cast(constant_col as double) from src),
q as (select column, quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.75) as q3 from b group by column),
f as (select column, q1 - 1.5 * (q3 - q1) as lo, q3 + 1.5 * (q3 - q1) as hi from q where q3 - q1 <> 0),
t as (select count(*) as rows from src)
select b.column, cast(count_if(v < lo or v > hi) as bigint) as outlier_count,
  round_even(count_if(v < lo or v > hi) * 100.0 / max(rows), 2) as outlier_percent,
  round_even(max(lo), 2) as lower_bound, round_even(max(hi), 2) as upper_bound, min(v) as min_value, max(v) as max_value
from b join f on b.column = f.column, t group by b.column having count_if(v < lo or v > hi) > 0""",
                                     ["outlier_percent", "lower_bound", "upper_bound", "min_value", "max_value"]))
def q_dq_outliers(spark, sf):
    return rounded(Q.detect_outliers(dirty_orders(spark, sf)))


@register("dq_constant", f"""with src as ({DIRTY_ORDERS_SQL})
select 'constant_col' as column, min(cast(constant_col as varchar)) as constant_value,
  min(cast(constant_col as varchar)) is null as all_missing from src having count(distinct constant_col) <= 1""")
def q_dq_constant(spark, sf):
    d = dirty_orders(spark, sf)
    return Q.detect_constant(d, Q.column_facts(d))


@register("dq_column_types", sql_rounded(f"""with {DIRTY_FACTS}
select column,
  case when n_distinct = 2 and is_bool_pair then 'boolean' when kind = 'numeric' then 'numeric'
       when {LOOKS_DATE} then 'datetime'
       when n_distinct <= 50 and round(n_distinct / greatest(rows, 1), 4) <= 0.5 then 'categorical'
       else 'text' end as detected_type,
  cast(n_distinct as bigint) as distinct_values, round(n_distinct / greatest(rows, 1), 4) as unique_ratio,
  case when not (n_distinct = 2 and is_bool_pair) and kind <> 'numeric' and not {LOOKS_DATE}
        and not (n_distinct <= 50 and round(n_distinct / greatest(rows, 1), 4) <= 0.5) then {TEXT_KIND} end as text_kind
from facts""", ["unique_ratio"]))
def q_dq_column_types(spark, sf):
    return rounded(Q.detect_column_types(Q.column_facts(dirty_orders(spark, sf))))


@register("dq_ids", sql_rounded(f"""with {DIRTY_FACTS}
select column, cast(n_distinct as bigint) as distinct_values, round(n_distinct / rows, 4) as unique_ratio,
  n_distinct = rows as is_fully_unique
from facts where non_null > 0 and rows > 0 and n_distinct / rows >= 0.95 and
  (case when kind = 'numeric' then all_whole and max - min + 1 <= 2.0 * n_distinct
        else {TEXT_KIND} <> 'free_text' and not {LOOKS_DATE} end)""", ["unique_ratio"]))
def q_dq_ids(spark, sf):
    return rounded(Q.detect_ids(Q.column_facts(dirty_orders(spark, sf))))


@register("dq_high_cardinality", sql_rounded(f"""with {CONTACT_FACTS}
select column, cast(n_distinct as bigint) as distinct_values, round(n_distinct / rows, 4) as unique_ratio
from facts where kind <> 'numeric' and non_null > 0 and n_distinct >= 20 and n_distinct / rows >= 0.5
  and not {LOOKS_DATE}""", ["unique_ratio"]))
def q_dq_high_cardinality(spark, sf):
    return rounded(Q.detect_high_cardinality(Q.column_facts(contacts(spark, sf))))


@register("dq_value_issues", sql_rounded(f"""with {DIRTY_FACTS}
select * from (select column,
  case when kind = 'numeric' and negatives > 0 then cast(negatives as bigint) end as negative_values,
  case when kind = 'numeric' and zeros > 0 then cast(zeros as bigint) end as zero_values,
  case when kind = 'text' and numeric_text / non_null >= 0.8 then round(numeric_text / non_null, 4) end
    as numeric_stored_as_text,
  case when kind = 'text' and whitespace > 0 then cast(whitespace as bigint) end as whitespace_values
  from facts where non_null > 0)
where coalesce(negative_values, zero_values, numeric_stored_as_text, whitespace_values) is not null""",
                                         ["numeric_stored_as_text"]))
def q_dq_value_issues(spark, sf):
    return rounded(Q.detect_value_issues(Q.column_facts(dirty_orders(spark, sf))))


def _inconsistent_sql():
    text = [c for c, _t, num in DIRTY_COLS if not num]
    long = " union all ".join(f"select '{c}' as column, cast({c} as varchar) as value from src where {c} is not null"
                              for c in text)
    return f"""with src as ({DIRTY_ORDERS_SQL}), long as (select distinct column, value from ({long})),
g as (select column, lower(trim(value)) as norm, list_sort(list(value)) as spellings from long
      group by column, lower(trim(value)) having count(*) > 1),
r as (select *, row_number() over (partition by column order by norm) as r from g)
select column, cast(count(*) as bigint) as inconsistent_groups,
  array_to_string(list_sort(list(case when r <= 5 then norm || '=' || array_to_string(spellings, '|') end)
    filter (where r <= 5)), '; ') as examples
from r group by column"""


@register("dq_inconsistent", _inconsistent_sql())
def q_dq_inconsistent(spark, sf):
    return Q.detect_inconsistent(dirty_orders(spark, sf))


@register("dq_personal_data", sql_rounded(f"""with {CONTACT_FACTS}
select column, case when emails / nonblank >= 0.5 then 'email' else 'phone' end as kind,
  round_even(case when emails / nonblank >= 0.5 then emails / nonblank else phones / nonblank end, 3) as share
from facts where kind = 'text' and nonblank > 0 and (emails / nonblank >= 0.5 or phones / nonblank >= 0.5)""",
                                          ["share"]))
def q_dq_personal(spark, sf):
    return rounded(Q.detect_personal_data(Q.column_facts(contacts(spark, sf))))


def _found(name: str) -> str:
    """Number of findings of a check on the dirty orders."""
    return f"(select count(*) from ({ORACLES[name]}))"


SCORE_SQL = f"""with {DIRTY_FACTS},
f as (select max(rows) as n, count(*) as cols, sum(nulls + blanks) as miss, count_if(n_distinct <= 1) as const from facts),
d as (select 100.0 * (count(*) - (select count(*) from (select distinct * from src))) / greatest(count(*), 1) as dup from src),
b as (select count_if(numeric_stored_as_text is not null or whitespace_values is not null) as broken from ({ORACLES["dq_value_issues"]})),
p as (select least(30.0, 100.0 * miss / (n * cols) * 1.5) as m, least(20.0, round_even(dup, 2) * 1.5) as d, least(15.0, 100.0 * const / cols) as c,
  least(20.0, 100.0 * {_found("dq_inconsistent")} / cols) as i, least(15.0, 100.0 * broken / cols) as x from f, d, b),
s as (select round_even(greatest(0.0, 100.0 - m - d - c - i - x), 1) as score, p.* from p)
select score, case when score >= 85 then 'good' when score >= 70 then 'fair' when score >= 50 then 'poor' else 'very poor' end as grade,
  round_even(m, 1) as missing_points, round_even(d, 1) as duplicate_points, round_even(c, 1) as constant_points,
  round_even(i, 1) as inconsistent_points, round_even(x, 1) as malformed_points from s"""


@register("dq_quality_score", sql_rounded(SCORE_SQL, ["score", "missing_points", "duplicate_points", "constant_points", "inconsistent_points", "malformed_points"]))
def q_dq_score(spark, sf):
    d = dirty_orders(spark, sf)
    facts = Q.column_facts(d)
    return rounded(Q.quality_score(d, facts, Q.detect_duplicates(d), Q.detect_inconsistent(d), Q.detect_value_issues(facts)))


REPORT_SQL = f"""with {DIRTY_FACTS},
found as (
  select 'duplicate_rows' as "check", count(*) - (select count(*) from (select distinct * from src)) as findings from src
  union all select 'missing_values', {_found("dq_missing")}
  union all select 'outliers', {_found("dq_outliers")}
  union all select 'constant_columns', (select count_if(n_distinct <= 1) from facts)
  union all select 'id_columns', {_found("dq_ids")}
  union all select 'high_cardinality', (select count(*) from facts where kind <> 'numeric' and non_null > 0 and n_distinct >= 20
    and n_distinct / rows >= 0.5 and not {LOOKS_DATE})
  union all select 'value_issues', {_found("dq_value_issues")}
  union all select 'consistency_issues', {_found("dq_inconsistent")}
  union all select 'personal_data', (select count(*) from facts where kind = 'text' and nonblank > 0
    and greatest(emails, phones) / nonblank >= {Q.PERSONAL_MIN_SHARE}))
select "check", findings > 0 as issues_found, cast(findings as bigint) as findings from found"""


@register("dq_quality_report", REPORT_SQL)
def q_dq_report(spark, sf):
    return Q.quality_report(dirty_orders(spark, sf))
