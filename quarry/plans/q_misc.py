"""Registered queries: projections, windows, sorts, sets and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import rows as W
from ..operators.clean import DECIMAL_COMMA, THOUSANDS, number_text
from ..operators.ranks import average_ranks, percent_rank_rows
from ..operators.stats import effect_label
from ..sources.publications import country_of
from ..sources.tables import read_table
from .fixtures import CONTACTS_SQL, PUBS_SQL, contacts, pubs
from .registry import register, rounded, sql_rounded


@register("prj_page", """
select * from orders order by o_orderkey limit 50 offset 100""")
def q_page(spark, sf):
    return W.page(read_table(spark, sf, "orders"), ["o_orderkey"], 100, 50)


@register("prj_search_rows", """
select * from customer where exists (select 1 from (select unnest([cast(c_custkey as varchar), c_name,
  cast(c_nationkey as varchar), cast(c_acctbal as varchar), c_mktsegment]) as v) where contains(lower(v), 'furniture'))""")
def q_search(spark, sf):
    return W.search_rows(read_table(spark, sf, "customer"), "FURNITURE")


@register("prj_prepare_rows", """
select cast(count(*) as bigint) as rows, cast(count(distinct o_orderstatus) as bigint) as classes
from orders where o_orderstatus is not null and not regexp_matches(o_orderstatus, '^\\s*$') and o_custkey is not null
  and o_totalprice is not null""")
def q_prepare(spark, sf):
    d = W.prepare_rows(read_table(spark, sf, "orders"), "o_orderstatus", ["o_totalprice", "o_custkey"],
                       "classification", group="o_custkey")
    return d.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("o_orderstatus").alias("classes"))


@register("prj_period_filter", f"""with p as ({PUBS_SQL})
select cast(count(*) as bigint) as documents from p where year >= 1994 and year < 1996""")
def q_period(spark, sf):
    return W.period_filter(pubs(spark, sf), 1994, 1996).agg(F.count(F.lit(1)).alias("documents"))


@register("prj_input_schema", sql_rounded("""
select 'o_totalprice' as name, 'number' as kind, cast(null as varchar[]) as choices,
  coalesce(bool_and(o_totalprice % 1 = 0), false) as integer, min(o_totalprice) as min, max(o_totalprice) as max,
  count_if(o_totalprice is null) > 0 as missing_ok from orders
union all select 'o_orderpriority', 'category', list_sort(list(distinct o_orderpriority)), false, null, null,
  count_if(o_orderpriority is null) > 0 from orders""", ["min", "max"]).replace(
    "select * replace", "select name, kind, array_to_string(choices, '|') as choices, integer, min, max, missing_ok "
                        "from (select * replace") + ")")
def q_schema(spark, sf):
    s = W.input_schema(read_table(spark, sf, "orders"), ["o_totalprice", "o_orderpriority"])
    return rounded(s).withColumn("choices", F.array_join("choices", "|"))


@register("prj_check_rows", """
with o as (select * from orders)
select o_orderkey, array_to_string(list_filter([case when o_orderpriority is not null and trim(o_orderpriority) <> ''
  and o_orderpriority not in ('1-URGENT', '2-HIGH', '3-MEDIUM') then 'o_orderpriority is not a learned category' end],
  lambda x: x is not null), '; ') as errors from o""")
def q_check(spark, sf):
    o = read_table(spark, sf, "orders")
    schema = W.input_schema(o.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM")),
                            ["o_orderpriority"])
    return W.check_rows(o, schema).select("o_orderkey", F.array_join("errors", "; ").alias("errors"))


@register("win_average_rank", sql_rounded("""
select o_totalprice as value, cast(count(*) as bigint) as n, min(r) + (count(*) - 1) / 2.0 as avg_rank from (
  select o_totalprice, rank() over (order by o_totalprice) as r from orders where o_totalprice is not null) group by 1""",
                                          ["value", "avg_rank"]))
def q_avg_rank(spark, sf):
    r = average_ranks(read_table(spark, sf, "orders"), "o_totalprice")
    return rounded(r.select(F.col("o_totalprice").alias("value"), "n", "avg_rank"))


@register("win_percent_rank", sql_rounded("""
select o_orderkey, case when c_acctbal is null then -1.0 else
  (rank() over (order by c_acctbal) + (count(*) over (partition by c_acctbal) - 1) / 2.0) /
  (select count(c_acctbal) from orders join customer on o_custkey = c_custkey) end as pct_rank
from orders join customer on o_custkey = c_custkey""", ["pct_rank"]))
def q_pct_rank(spark, sf):
    o = read_table(spark, sf, "orders").join(read_table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rounded(percent_rank_rows(o.select("o_orderkey", "c_acctbal"), "c_acctbal").select("o_orderkey", "pct_rank"))


@register("win_keep_first", """
select o_orderstatus, o_orderpriority, min(o_orderkey) as o_orderkey from orders group by 1, 2""")
def q_keep_first(spark, sf):
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return W.keep_first(o, "o_orderkey")


@register("srt_run_comparison", sql_rounded("""
with s as (select c_mktsegment as fingerprint, o_orderpriority as model, avg(o_totalprice) as score
           from orders join customer on o_custkey = c_custkey group by 1, 2)
select fingerprint, model, score, cast(rank() over (partition by fingerprint order by score desc, model) as integer) as rank
from s""", ["score"]))
def q_runs(spark, sf):
    from pyspark.sql import Window
    o = read_table(spark, sf, "orders").join(read_table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    s = o.groupBy(F.col("c_mktsegment").alias("fingerprint"), F.col("o_orderpriority").alias("model")).agg(
        F.avg("o_totalprice").alias("score"))
    w = Window.partitionBy("fingerprint").orderBy(F.desc("score"), "model")  # over the small results table
    return rounded(s.withColumn("rank", F.rank().over(w)))


@register("set_union_distinct", """
select cast(count(*) as bigint) as rows from (select o_custkey from orders union select c_custkey from customer)""")
def q_union(spark, sf):
    a = read_table(spark, sf, "orders").select(F.col("o_custkey").alias("k"))
    b = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    return a.union(b).distinct().agg(F.count(F.lit(1)).alias("rows"))


@register("set_array_ops", f"""with p as ({PUBS_SQL})
select doc_id, cast(len(list_distinct(keywords)) as bigint) as n_keywords,
  cast(len(list_intersect(keywords, ['brand#11', 'brand#12', 'brand#13'])) as bigint) as n_shared from p""")
def q_array_ops(spark, sf):
    p = pubs(spark, sf)
    ref = F.array(*[F.lit(b) for b in ("brand#11", "brand#12", "brand#13")])
    return p.select("doc_id", F.size(F.array_distinct("keywords")).cast("long").alias("n_keywords"),
                    F.size(F.array_intersect("keywords", ref)).cast("long").alias("n_shared"))


@register("fn_contact_checks", f"""with c as ({CONTACTS_SQL})
select row_id, regexp_matches(trim(email), '{T.EMAIL_RE}') as is_email,
  regexp_matches(trim(phone), '{T.PHONE_RE}') and length(regexp_replace(trim(phone), '\\D', '', 'g')) between 7 and 15
    and regexp_matches(trim(phone), '[+ ()\\-.]') as is_phone from c""")
def q_contacts(spark, sf):
    c = contacts(spark, sf)
    return c.select("row_id", T.is_email(F.col("email")).alias("is_email"), T.is_phone(F.col("phone")).alias("is_phone"))


@register("fn_reference_functions", f"""with p as ({PUBS_SQL}),
r as (select doc_id, unnest(refs) as ref from p)
select doc_id, ref, regexp_replace(regexp_replace(lower(trim(' ' || upper(ref) || '. ;')), '\\s+', ' ', 'g'), '[.;, ]+$', '')
  as ref_key,
  regexp_replace(lower(trim('https://doi.org/' || ref)), '^(https?://(dx\\.)?doi\\.org/|doi:\\s*)', '') as doi,
  array_to_string(regexp_extract_all(lower('see ' || ref || '. and ' || ref), '(10\\.\\d{{4,9}}/[^\\s;,]+)', 1), '|') as raw
from r""")
def q_ref_fns(spark, sf):
    p = pubs(spark, sf).select("doc_id", F.explode("refs").alias("ref"))
    return p.select("doc_id", "ref", T.ref_key(F.concat(F.lit(" "), F.upper("ref"), F.lit(". ;"))).alias("ref_key"),
                    T.normalise_doi(F.concat(F.lit("https://doi.org/"), F.col("ref"))).alias("doi"),
                    F.array_join(F.regexp_extract_all(F.lower(F.concat(F.lit("see "), "ref", F.lit(". and "), "ref")),
                                                      F.lit(f"({T.DOI_RE})"), 1), "|").alias("raw"))


@register("fn_extract_dois", f"""with p as ({PUBS_SQL}),
r as (select doc_id, unnest(refs) as ref from p)
select doc_id, array_to_string(list_transform(regexp_extract_all(lower('cited ' || ref || '. '), '(10\\.\\d{{4,9}}/[^\\s;,]+)', 1),
  lambda x: regexp_replace(x, '\\.+$', '')), '|') as dois from r""")
def q_dois(spark, sf):
    p = pubs(spark, sf).select("doc_id", F.explode("refs").alias("ref"))
    return p.select("doc_id", F.array_join(T.extract_dois(F.concat(F.lit("cited "), "ref", F.lit(". "))), "|").alias("dois"))


@register("fn_text_functions", """
select doc_id, cast(case when text is null then null when trim(text) = '' then 0
  else len(string_split_regex(trim(text), '\\s+')) end as integer) as words,
  try_cast(nullif(regexp_extract(source, '(\\d{4})', 1), '') as integer) as year4 from documents""")
def q_text_fns(spark, sf):
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", T.word_count(F.col("text")).cast("int").alias("words"),
                    T.year_of(F.col("source")).alias("year4"))


@register("fn_number_text", sql_rounded(f"""
select o_orderkey, try_cast(replace(replace(trim(cast(o_totalprice as varchar)), '.', ''), ',', '.') as double) as dec_comma,
  round(o_totalprice, 2) as thousands from orders""",
                                         ["dec_comma", "thousands"]))
def q_number_text(spark, sf):
    o = read_table(spark, sf, "orders")
    return rounded(o.select("o_orderkey", number_text(F.col("o_totalprice").cast("string"), DECIMAL_COMMA).alias("dec_comma"),
                            number_text(F.format_number("o_totalprice", 2), THOUSANDS).alias("thousands")))


@register("fn_country_names")
def q_country(spark, sf):
    """FN-01 on affiliations built from nation names (upper case, postcode)."""
    n = read_table(spark, sf, "nation")
    aff = F.concat(F.lit("Dept. of Trade, Univ. of Somewhere, 10115 "), F.col("n_name"), F.lit("."))
    return n.select("n_name", country_of(aff).alias("country"))


LABEL_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("fn_effect_labels", sql_rounded("select a, b, r, case when abs(r) < 0.1 then 'negligible' when abs(r) < 0.3 then 'small' "
          "when abs(r) < 0.5 then 'medium' else 'large' end as magnitude from (" + " union all ".join(
              f"select '{a}' as a, '{b}' as b, corr({a}, {b}) as r from lineitem"
              for i, a in enumerate(LABEL_COLS) for b in LABEL_COLS[i + 1:]) + ")", ["r"]))
def q_labels(spark, sf):
    """FN-12: magnitude labels of the correlations between lineitem measures."""
    from ..operators.profile import correlation_matrix
    cm = correlation_matrix(read_table(spark, sf, "lineitem"), LABEL_COLS)
    return rounded(cm.select(F.col("col_a").alias("a"), F.col("col_b").alias("b"), "r", effect_label("r", F.col("r")).alias("magnitude")))
