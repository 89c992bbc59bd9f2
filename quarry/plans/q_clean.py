"""Registered queries: cleaning ops (CLN-*, PRJ-03/04/05, SET-02)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.clean import apply_clean, clean_summary
from .fixtures import DIRTY_ORDERS_SQL, SURVEY_SQL, dirty_orders, survey
from .registry import register, rounded, sql_rounded

TOKENS = "('', 'na', 'n/a', 'nan', 'null', 'none', '-', '--', '?', 'missing', 'unknown')"

DIRTY_CHAIN = [
    {"op": "trim_whitespace", "column": "segment"},
    {"op": "merge_categories", "column": "segment"},
    {"op": "nullify", "column": "segment"},
    {"op": "nullify", "column": "amount_text"},
    {"op": "retype", "column": "amount_text", "to": "number"},
    {"op": "nullify", "column": "balance", "values": [0]},
    {"op": "retype", "column": "day_text", "to": "datetime"},
    {"op": "map_values", "column": "priority", "mapping": {"1-URGENT": "urgent", "5-LOW": "low"}},
    {"op": "rename_column", "column": "amount_text", "to": "amount"},
    {"op": "drop_column", "column": "constant_col"},
    {"op": "drop_duplicates"},
]


def cleaned_orders(spark, sf):
    df, ops = apply_clean(dirty_orders(spark, sf), DIRTY_CHAIN)
    return df, ops


CLEAN_CHAIN_SQL = f"""
with src as ({DIRTY_ORDERS_SQL}),
a as (select row_id,
  lower(regexp_replace(regexp_replace(segment, '^\\s+|\\s+$', '', 'g'), '^\\s+|\\s+$', '', 'g')) as seg0,
  case when lower(trim(amount_text)) in {TOKENS} then null else amount_text end as amt0,
  case when balance = 0 then null else balance end as balance,
  day_text, priority, price from src)
select distinct row_id,
  case when lower(trim(seg0)) in {TOKENS} then null else seg0 end as segment,
  cast(round(try_cast(replace(trim(amt0), ',', '') as double)) as bigint) as amount,
  balance,
  cast(cast(try_strptime(trim(day_text), '%d/%m/%Y') as timestamp) as varchar) as day_text,
  case priority when '1-URGENT' then 'urgent' when '5-LOW' then 'low' else priority end as priority,
  price
from a"""


@register("clean_chain_orders", sql_rounded(CLEAN_CHAIN_SQL, ["balance", "price"]))
def q_clean_chain(spark, sf):
    df, _ = cleaned_orders(spark, sf)
    return rounded(df.withColumn("day_text", F.col("day_text").cast("string")))


@register("clean_decisions_orders")
def q_clean_decisions(spark, sf):
    """The decisions recorded into the ops (comma reading, day-first, integer)."""
    _, ops = cleaned_orders(spark, sf)
    rows = [(i, o["op"], o.get("column"), str(o.get("commas")), str(o.get("dayfirst")), str(o.get("integer")))
            for i, o in enumerate(ops)]
    return spark.createDataFrame(rows, "step int, op string, column string, commas string, dayfirst string, "
                                       "integer string")


@register("clean_summary_orders")
def q_clean_summary(spark, sf):
    before = dirty_orders(spark, sf)
    after, ops = apply_clean(before, DIRTY_CHAIN)
    return clean_summary(before, after, ops)


SURVEY_CHAIN = [
    {"op": "reverse_score", "column": "q4", "low": 1, "high": 5},
    {"op": "composite", "columns": ["q1", "q2", "q3", "q4"], "to": "wellbeing", "method": "mean"},
    {"op": "composite", "columns": ["q1", "q2", "q3"], "to": "total", "method": "sum"},
]


@register("clean_reverse_composite", sql_rounded(f"""
with s as ({SURVEY_SQL}), r as (select okey, line, q1, q2, q3, cast(1.0 + 5.0 - q4 as bigint) as q4 from s)
select okey, line, q1, q2, q3, q4, (q1 + q2 + q3 + q4) / 4.0 as wellbeing, cast(q1 + q2 + q3 as double) as total
from r""", ["wellbeing", "total"]))
def q_reverse_composite(spark, sf):
    s = survey(spark, sf).select("okey", "line", "q1", "q2", "q3", "q4")
    df, _ = apply_clean(s, SURVEY_CHAIN)
    return rounded(df)


@register("clean_drop_missing_rows", f"""
with src as ({DIRTY_ORDERS_SQL})
select cast(count(*) as bigint) as rows_left from src
where not (segment is null or regexp_matches(segment, '^\\s*$') or amount_text is null)""")
def q_drop_missing(spark, sf):
    df, _ = apply_clean(dirty_orders(spark, sf), [{"op": "drop_missing_rows", "columns": ["segment", "amount_text"]}])
    return df.agg(F.count(F.lit(1)).alias("rows_left"))


@register("clean_drop_duplicates", """
select cast(count(*) as bigint) as rows_left from (select distinct o_orderstatus, o_orderpriority, o_custkey from orders)""")
def q_drop_duplicates(spark, sf):
    from ..sources.tables import read_table
    o = read_table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority", "o_custkey")
    df, _ = apply_clean(o, [{"op": "drop_duplicates"}])
    return df.agg(F.count(F.lit(1)).alias("rows_left"))


@register("clean_replay_orders", sql_rounded(CLEAN_CHAIN_SQL.replace("select distinct", "select"),
                                             ["balance", "price"]))
def q_clean_replay(spark, sf):
    """FIT-18 for clean ops: the recorded ops replayed on the raw rows (row
    ops skipped, no aggregation needed) give the same table."""
    _, ops = cleaned_orders(spark, sf)
    df, _ = apply_clean(dirty_orders(spark, sf), ops, replay=True)
    return rounded(df.withColumn("day_text", F.col("day_text").cast("string")))
