"""Registered queries: preprocessing, splits, resampling, selection, TF-IDF."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import prep as R
from ..session import cut_lineage
from ..sources.tables import read_table
from .q_clean import CLEAN_CHAIN_SQL, cleaned_orders
from .registry import register, rounded, sql_rounded

MD5 = "md5(concat_ws('|', '42', cast({k} as varchar)))"


@register("prep_split_stratified", f"""
with o as (select o_orderkey, o_orderpriority, row_number() over (partition by o_orderpriority
           order by {MD5.format(k='o_orderkey')}) as r, count(*) over (partition by o_orderpriority) as n from orders)
select o_orderkey, case when r <= round_even(n * 0.2, 0) then 'test' else 'train' end as __split__ from o""")
def q_split(spark, sf):
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return R.split(o, "o_orderkey", 0.2, 42, "o_orderpriority").select("o_orderkey", "__split__")


@register("prep_split_grouped", f"""
with g as (select distinct o_custkey from orders where o_custkey is not null),
r as (select o_custkey, row_number() over (order by {MD5.format(k='o_custkey')}) as r, count(*) over () as n from g)
select o.o_orderkey, case when r.r <= round(r.n * 0.2) then 'test' else 'train' end as __split__
from orders o left join r on o.o_custkey = r.o_custkey""")
def q_split_grouped(spark, sf):
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return R.split_grouped(o, "o_custkey", 0.2, 42).select("o_orderkey", "__split__")


@register("prep_folds_stratified", f"""
select o_orderkey, cast((row_number() over (partition by o_orderpriority order by {MD5.format(k='o_orderkey')}) - 1) % 5
  as integer) as fold from orders""")
def q_folds(spark, sf):
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return R.assign_folds(o, "o_orderkey", 5, 42, "o_orderpriority").select("o_orderkey", "fold")


@register("prep_folds_grouped", f"""
with g as (select distinct o_custkey from orders),
r as (select o_custkey, cast((row_number() over (order by {MD5.format(k='o_custkey')}) - 1) % 5 as integer) as fold from g)
select o.o_orderkey, r.fold from orders o left join r on o.o_custkey = r.o_custkey""")
def q_folds_grouped(spark, sf):
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return R.assign_folds(o, "o_orderkey", 5, 42, group="o_custkey").select("o_orderkey", "fold")


PLAN = {
    "balance": [{"op": "impute", "strategy": "median"}, {"op": "scale", "method": "standard"}],
    "price": [{"op": "outliers", "method": "clip_iqr"}, {"op": "scale", "method": "minmax"}],
    "amount": [{"op": "impute", "strategy": "most_frequent"}, {"op": "outliers", "method": "winsorize"}],
    "segment": [{"op": "impute", "strategy": "most_frequent"}],
    "priority": [{"op": "encode", "method": "onehot"}],
}
PRIORITIES = ["2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "low", "urgent"]


def _prep_sql():
    onehot = ", ".join(f"""cast(coalesce(priority = '{p}', false) as bigint) as "priority_{p}" """ for p in PRIORITIES)
    return f"""with c as ({CLEAN_CHAIN_SQL}),
s as (select c.*, case when row_number() over (order by {MD5.format(k='row_id')}) <= round_even(count(*) over () * 0.2, 0)
      then 'test' else 'train' end as __split__ from c),
tr as (select * from s where __split__ = 'train'),
st1 as (select quantile_cont(balance, 0.5) as bmed, quantile_cont(price, 0.25) as pq1, quantile_cont(price, 0.75) as pq3
        from tr),
am as (select amount as v, count(*) as k from tr where amount is not null group by amount order by k desc, v limit 1),
sm as (select segment as v, count(*) as k from tr where segment is not null and not regexp_matches(segment, '^\\s*$')
       group by segment order by k desc, v limit 1),
tr2 as (select coalesce(balance, st1.bmed) as b,
        least(greatest(price, pq1 - 1.5 * (pq3 - pq1)), pq3 + 1.5 * (pq3 - pq1)) as p,
        cast(round(coalesce(cast(amount as double), (select cast(v as double) from am))) as bigint) as a from tr, st1),
st2 as (select avg(b) as bm, stddev_pop(b) as bs, min(p) as pmin, max(p) as pmax,
        quantile_cont(a, 0.05) as alo, quantile_cont(a, 0.95) as ahi from tr2)
select s.row_id, case when (select v from sm) is not null and (s.segment is null or regexp_matches(s.segment, '^\\s*$'))
    then (select v from sm) else s.segment end as segment,
  cast(round(least(greatest(cast(round(coalesce(cast(s.amount as double), (select cast(v as double) from am))) as bigint),
    st2.alo), st2.ahi)) as bigint) as amount,
  (coalesce(s.balance, st1.bmed) - st2.bm) / case when st2.bs = 0 then 1 else st2.bs end as balance,
  s.day_text, {onehot},
  (least(greatest(s.price, st1.pq1 - 1.5 * (st1.pq3 - st1.pq1)), st1.pq3 + 1.5 * (st1.pq3 - st1.pq1)) - st2.pmin)
    / case when st2.pmax - st2.pmin = 0 then 1 else st2.pmax - st2.pmin end as price,
  s.__split__
from s, st1, st2"""


@register("prep_fit_transform", sql_rounded(_prep_sql(), ["balance", "price"]))
def q_prep(spark, sf):
    df, _ = cleaned_orders(spark, sf)
    df = cut_lineage(df.withColumn("day_text", F.col("day_text").cast("string")))  # the split reads it several times
    s = cut_lineage(R.split(df, "row_id", 0.2, 42))
    state = R.fit_prep(s.where(F.col("__split__") == "train"), PLAN, key="row_id")
    return rounded(R.transform(state, s))


@register("prep_class_weights", sql_rounded("""
with g as (select cast(l_returnflag as varchar) as class, count(*) as n_c from lineitem where l_returnflag is not null
           group by 1), t as (select sum(n_c) as n, count(*) as k from g)
select class, cast(n_c as bigint) as n_c, round(n / (k * n_c), 3) as weight from g, t""", ["weight"]))
def q_weights(spark, sf):
    return rounded(R.class_weights(read_table(spark, sf, "lineitem"), "l_returnflag"))


@register("prep_oversample_counts", """
with g as (select o_orderstatus as c, count(*) as n from orders where o_orderstatus is not null group by 1)
select c as o_orderstatus, cast((select max(n) from g) as bigint) as count from g""")
def q_over(spark, sf):
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return R.resample(o, "o_orderstatus", "o_orderkey", "oversample").groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("count"))


@register("prep_undersample_rows", f"""
with g as (select o_orderstatus as c, count(*) as n from orders where o_orderstatus is not null group by 1),
r as (select o_orderkey, o_orderstatus, row_number() over (partition by o_orderstatus
      order by {MD5.format(k='o_orderkey')}) as r from orders where o_orderstatus is not null)
select o_orderkey, o_orderstatus from r where r <= (select min(n) from g)""")
def q_under(spark, sf):
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return R.resample(o, "o_orderstatus", "o_orderkey", "undersample").select("o_orderkey", "o_orderstatus")


FEATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _anova_sql():
    parts = []
    for f in FEATS:
        parts.append(f"""select '{f}' as feature, (sum(n * power(a - ga, 2)) / (count(*) - 1)) /
  (sum((n - 1) * v) / (sum(n) - count(*))) as score from (select l_returnflag, count(*) as n, avg({f}) as a,
  var_samp({f}) as v, (select avg({f}) from lineitem where l_returnflag is not null) as ga from lineitem
  where l_returnflag is not null group by l_returnflag)""")
    body = " union all ".join(parts)
    return sql_rounded(f"""with sc as ({body}), r as (select *, row_number() over (order by score desc,
  case feature {' '.join(f"when '{f}' then {i}" for i, f in enumerate(FEATS))} end) as rk from sc)
select feature, score, rk <= 2 as selected from r""", ["score"])


@register("prep_select_anova", _anova_sql())
def q_sel_anova(spark, sf):
    return rounded(R.select_features(read_table(spark, sf, "lineitem"), FEATS, "l_returnflag", "anova", 2))


def _chi2_sql():
    parts = []
    for f in FEATS:
        parts.append(f"""select '{f}' as feature, sum(power(s - n / tn * ts, 2) / (n / tn * ts)) as score from (
  select l_returnflag, count(*) as n, sum({f} - (select min({f}) from lineitem)) as s,
    (select count(*) from lineitem where l_returnflag is not null) as tn,
    (select sum({f} - (select min({f}) from lineitem)) from lineitem where l_returnflag is not null) as ts
  from lineitem where l_returnflag is not null group by l_returnflag)""")
    body = " union all ".join(parts)
    return sql_rounded(f"""with sc as ({body}), r as (select *, row_number() over (order by score desc,
  case feature {' '.join(f"when '{f}' then {i}" for i, f in enumerate(FEATS))} end) as rk from sc)
select feature, score, rk <= 2 as selected from r""", ["score"])


@register("prep_select_chi2", _chi2_sql())
def q_sel_chi2(spark, sf):
    return rounded(R.select_features(read_table(spark, sf, "lineitem"), FEATS, "l_returnflag", "chi2", 2))


def _corr_sel_sql():
    parts = [f"""select '{f}' as feature, abs(corr({f}, case when l_linestatus = 'F' then 0.0 else 1.0 end)) as score
from lineitem where l_linestatus is not null""" for f in FEATS]
    body = " union all ".join(parts)
    return sql_rounded(f"""with sc as ({body}), r as (select *, row_number() over (order by score desc,
  case feature {' '.join(f"when '{f}' then {i}" for i, f in enumerate(FEATS))} end) as rk from sc)
select feature, score, rk <= 2 as selected from r""", ["score"])


@register("prep_select_correlation", _corr_sel_sql())
def q_sel_corr(spark, sf):
    return rounded(R.select_features(read_table(spark, sf, "lineitem"), FEATS, "l_linestatus", "correlation", 0.5))


@register("prep_remove_outlier_rows", """
with a as (select * from lineitem),
b1 as (select quantile_cont(l_extendedprice, 0.25) as q1, quantile_cont(l_extendedprice, 0.75) as q3 from a),
f1 as (select a.* from a, b1 where l_extendedprice is null or l_extendedprice between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)),
b2 as (select quantile_cont(l_quantity, 0.25) as q1, quantile_cont(l_quantity, 0.75) as q3 from f1),
f2 as (select f1.* from f1, b2 where l_quantity is null or l_quantity between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1))
select cast(count(*) as bigint) as rows_left from f2""")
def q_remove_rows(spark, sf):
    li = read_table(spark, sf, "lineitem")
    return R.remove_outlier_rows(li, ["l_extendedprice", "l_quantity"]).agg(F.count(F.lit(1)).alias("rows_left"))


TOK = "[\\p{L}\\p{N}_]{2,}"


@register("prep_tfidf_words", sql_rounded(f"""
with d as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '({TOK})', 1) as t from documents),
s as (select doc_id, case when row_number() over (order by {MD5.format(k='doc_id')}) <= round_even(count(*) over () * 0.2, 0)
      then 'test' else 'train' end as sp from documents),
u as (select doc_id, unnest(t) as term from d
      union all select doc_id, t[i] || ' ' || t[i + 1] from (select doc_id, t, unnest(range(1, len(t))) as i from d)),
tr as (select u.* from u join s on u.doc_id = s.doc_id where s.sp = 'train'),
nd as (select count(*) as n from s where sp = 'train'),
idf as (select term, ln((1.0 + (select n from nd)) / (1.0 + count(distinct doc_id))) + 1 as idf from tr group by term),
tf as (select doc_id, term, count(*) as tf from u group by 1, 2),
w as (select tf.doc_id, tf.term, (1 + ln(tf.tf)) * idf.idf as w from tf join idf on tf.term = idf.term),
nr as (select doc_id, sqrt(sum(w * w)) as norm from w group by doc_id)
select w.doc_id as doc, w.term, w.w / nr.norm as weight from w join nr on w.doc_id = nr.doc_id""", ["weight"]))
def q_tfidf(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    # the split ranks only the ids (texts never pass through its joins); terms are counted
    # where their document is and tagged with the split there, once for idf and once for
    # weights: the texts are far smaller than a stored (doc, term, tf) table
    sp = R.split(docs.select("doc_id"), "doc_id", 0.2, 42).select(F.col("doc_id").alias("doc"), "__split__")
    tf = R.term_counts(R.word_ngrams(docs, "doc_id", "text", 2)).join(sp, "doc")
    idf = R.tfidf_fit(tf.where(F.col("__split__") == "train"), sp.where(F.col("__split__") == "train").count())
    return rounded(R.tfidf_transform(tf.drop("__split__"), idf))


CHAR_WB_SQL = """
with w as (select item_id as doc, unnest(string_split_regex(trim(lower(coalesce(text, ''))), '[ \\t\\n\\x0B\\f\\r]+')) as w from benchmark),
p as (select doc, ' ' || w || ' ' as w from w where len(w) > 0),
u as (select doc, unnest(list_transform(range(greatest(len(w) - n, 0) + 1), lambda o: substr(w, o + 1, n))) as term
      from p, (select unnest([3, 4, 5]) as n) where len(w) >= n or n = 3),
tf as (select doc, term, count(*) as tf from u group by all),
idf as (select term, ln((1.0 + (select count(*) from benchmark)) / (1.0 + count(*))) + 1 as idf from tf group by term),
w2 as (select doc, term, (1 + ln(tf)) * idf as w from tf join idf using (term))
select doc, term, w / sqrt(sum(w * w) over (partition by doc)) as weight from w2"""


@register("prep_tfidf_char_wb", sql_rounded(CHAR_WB_SQL, ["weight"]))
def q_tfidf_char(spark, sf):
    docs = read_table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    tf = R.term_counts(R.char_wb_ngrams(docs, "doc_id", "text", 3, 5))
    return rounded(R.tfidf_transform(tf, R.tfidf_fit(tf, docs.count())))


MI_BINS = 10


def _mi_sql(features):
    probs = ", ".join(str(i / MI_BINS) for i in range(1, MI_BINS))
    long = " union all ".join(f"select '{f}' as feature, cast({f} as double) as v, l_returnflag as y from lineitem where {f} is not null and l_returnflag is not null" for f in features)
    return f"""with v as ({long}),
cuts as (select feature, unnest(quantile_cont(v, [{probs}])) as cut from v group by feature),
x as (select v.feature, v.v, v.y, (select count(*) from cuts c where c.feature = v.feature and v.v > c.cut) as x from v),
j as (select feature, x, y, count(*) as nxy from x group by all),
m as (select *, sum(nxy) over (partition by feature) as n, sum(nxy) over (partition by feature, x) as nx, sum(nxy) over (partition by feature, y) as ny from j)
select feature, sum(nxy / n * ln(nxy * n / (nx * ny))) as mi from m group by feature"""


@register("prep_mutual_info", sql_rounded(_mi_sql(FEATS), ["mi"]))
def q_mi(spark, sf):
    return rounded(R.mutual_info(read_table(spark, sf, "lineitem"), FEATS, "l_returnflag"))


@register("prep_pca")
def q_pca(spark, sf):
    from .fixtures import DIMS, vectors
    v = vectors(spark, sf)
    _, apply = R.pca(v, [f"x{i}" for i in range(DIMS)], 0.9, scale=True)
    return apply(v)


NUMBERS = ["n_chars", "n_words"]


def _text_rows(spark, sf):
    """documents with two numbers beside the text."""
    from ..functions.text import word_count
    return read_table(spark, sf, "documents").select("doc_id", "lang", "text", "n_chars", word_count(F.col("text")).alias("n_words"))


@register("prep_assemble_blocks", sql_rounded(f"""
with d as (select doc_id, n_chars, regexp_extract_all(lower(coalesce(text, '')), '({TOK})', 1) as t,
  len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')) as n_words,
  row_number() over (order by {MD5.format(k='doc_id')}) <= round_even(count(*) over () * 0.2, 0) as test from documents),
tf as (select doc_id, term, count(*) as tf from (select doc_id, unnest(t) as term from d) group by all),
idf as (select term, ln((1.0 + (select count(*) from d where not test)) / (1.0 + count(*))) + 1 as idf,
  row_number() over (order by term) + 1 as place
  from tf join d using (doc_id) where not test group by term),
w as (select doc_id, place, (1 + ln(tf)) * idf as w from tf join idf using (term)),
u as (select doc_id, place, w / sqrt(sum(w * w) over (partition by doc_id)) as w from w),
g as (select doc_id, count(*) as n, sum(w * w) as sq, sum(w * place) as dot, min(place) as first from u group by doc_id)
select d.doc_id, (select count(*) from idf) + 2 as size, coalesce(g.n, 0) + (n_chars <> 0)::int + (n_words <> 0)::int as entries,
  coalesce(sq, 0) + n_chars * n_chars + n_words * n_words as squares, coalesce(dot, 0) + n_words as dot,
  case when n_chars <> 0 then 0 when n_words <> 0 then 1 else first end as first_index
from d left join g using (doc_id)""", ["squares", "dot"]))
def q_assemble(spark, sf):
    """Two numbers and a TF-IDF block fitted on training documents as one sparse vector: its
    size, entries, squared length and its product with (0, 1, 2, ...)."""
    from ..operators.assemble import TextBlock, assemble, stored_entries
    docs = _text_rows(spark, sf).drop("lang")
    taught = R.split(docs.select("doc_id"), "doc_id", 0.2, 42).where(F.col("__split__") == "train").select("doc_id").distinct().withColumn("taught", F.lit(True))
    docs = docs.join(taught, "doc_id", "left").withColumn("taught", F.coalesce("taught", F.lit(False)))
    block = TextBlock(docs, "doc_id", "text", taught="taught", n_max=1)
    v = stored_entries(assemble(docs, "doc_id", NUMBERS, [block], keep=["doc_id"]))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return rounded(v.select("doc_id", F.col("size").cast("long").alias("size"), F.size("indices").cast("long").alias("entries"), total(F.transform("values", lambda x: x * x)).alias("squares"),
                            total(F.zip_with("indices", "values", lambda i, x: i * x)).alias("dot"), F.col("indices")[0].cast("long").alias("first_index")))


GAPS = ["a", "b", "c", "p"]
GAPS_SQL = """select p_partkey as k, case when p_partkey % 7 = 0 then null else avg(l_quantity) end as a,
  case when p_partkey % 5 = 0 then null else 100 * avg(l_discount) end as b, 100 * avg(l_tax) as c, any_value(p_retailprice) / 100 as p
from lineitem join part on l_partkey = p_partkey group by p_partkey"""


@register("prep_knn_impute_block", sql_rounded(f"""
with g as ({GAPS_SQL}),
cells as (select k, 'a' as col from g where a is null union all select k, 'b' from g where b is null),
far as (select cells.k, cells.col, t.k as donor, case cells.col when 'a' then t.a else t.b end as v,
  sqrt(4.0 / (2 + (x.a is not null and t.a is not null)::int + (x.b is not null and t.b is not null)::int) *
    (coalesce(power(x.a - t.a, 2), 0) + coalesce(power(x.b - t.b, 2), 0) + power(x.c - t.c, 2) + power(x.p - t.p, 2))) as d
  from cells join g x using (k) join g t on (case cells.col when 'a' then t.a else t.b end) is not null),
top as (select *, row_number() over (partition by k, col order by d, donor) as r from far),
fill as (select k, avg(v) filter (where col = 'a') as fa, avg(v) filter (where col = 'b') as fb from top where r <= 5 group by k)
select g.k, coalesce(a, fa) as a, coalesce(b, fb) as b, c, p from g left join fill using (k)""", ["a", "b", "c", "p"]))
def q_knn_block(spark, sf):
    """Gaps in two of four columns, rows with both included, filled by nan-Euclidean neighbours."""
    from ..operators.knn import knn_impute_block
    li, part = read_table(spark, sf, "lineitem"), read_table(spark, sf, "part").select("p_partkey", "p_retailprice")
    g = li.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.avg("l_quantity").alias("a"), (100 * F.avg("l_discount")).alias("b"), (100 * F.avg("l_tax")).alias("c")).join(part, "p_partkey")
    k = F.col("p_partkey")
    g = g.select(k.alias("k"), F.when(k % 7 != 0, F.col("a")).alias("a"), F.when(k % 5 != 0, F.col("b")).alias("b"), "c", (F.col("p_retailprice") / 100).alias("p"))
    return rounded(knn_impute_block(g, g, GAPS, "k", 5))
