"""Derived analysis tables built from the driver's parquet tables.

The reference works on uploaded spreadsheets and publication exports; the
operators here are exercised on tables Spark derives from the TPC-H-like data,
so their work grows with the input. Each builder is a pure DataFrame plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..sources.tables import read_table


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1: orders x customer with deterministic dirt (case/space variants,
    blanks, 'n/a', thousands commas, day/month text, a constant column)."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice",
                                                   "o_orderdate", "o_orderpriority")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    j = o.join(c, o.o_custkey == c.c_custkey)
    k = F.col("o_orderkey")
    seg = (F.when(k % 17 == 0, F.lit(None).cast("string"))
           .when(k % 23 == 0, F.lit("  "))
           .when(k % 3 == 0, F.upper("c_mktsegment"))
           .when(k % 3 == 1, F.concat(F.lit(" "), F.lower("c_mktsegment")))
           .otherwise(F.col("c_mktsegment")))
    fl = F.floor("o_totalprice").cast("bigint")
    amount = (F.when(k % 29 == 0, F.lit("n/a"))
              .when(F.col("o_totalprice") >= 1000,
                    F.concat(F.floor(F.col("o_totalprice") / 1000).cast("bigint").cast("string"), F.lit(","),
                             F.lpad((fl % 1000).cast("string"), 3, "0")))
              .otherwise(fl.cast("string")))
    day_text = F.concat(F.lpad(F.dayofmonth("o_orderdate").cast("string"), 2, "0"), F.lit("/"),
                        F.lpad(F.month("o_orderdate").cast("string"), 2, "0"), F.lit("/"),
                        F.year("o_orderdate").cast("string"))
    return j.select(k.alias("row_id"), seg.alias("segment"), amount.alias("amount_text"),
                    F.when(k % 31 == 0, F.lit(0.0)).otherwise(F.col("c_acctbal")).alias("balance"),
                    day_text.alias("day_text"), F.col("o_orderpriority").alias("priority"),
                    F.col("o_totalprice").alias("price"), F.lit(1).alias("constant_col"))


DIRTY_ORDERS_SQL = """
select o_orderkey as row_id,
  case when o_orderkey % 17 = 0 then null when o_orderkey % 23 = 0 then '  '
       when o_orderkey % 3 = 0 then upper(c_mktsegment)
       when o_orderkey % 3 = 1 then concat(' ', lower(c_mktsegment))
       else c_mktsegment end as segment,
  case when o_orderkey % 29 = 0 then 'n/a'
       when o_totalprice >= 1000 then concat(
            cast(cast(floor(o_totalprice/1000) as bigint) as VARCHAR), ',',
            lpad(cast(cast(floor(o_totalprice) as bigint) % 1000 as VARCHAR), 3, '0'))
       else cast(cast(floor(o_totalprice) as bigint) as VARCHAR) end as amount_text,
  case when o_orderkey % 31 = 0 then 0.0 else c_acctbal end as balance,
  concat(lpad(cast(day(o_orderdate) as VARCHAR),2,'0'),'/',
         lpad(cast(month(o_orderdate) as VARCHAR),2,'0'),'/',
         cast(year(o_orderdate) as VARCHAR)) as day_text,
  o_orderpriority as priority, o_totalprice as price, 1 as constant_col
from orders join customer on o_custkey = c_custkey
"""


def pubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C2: publication-shaped table. document = order, authors = suppliers,
    countries = supplier nations, keywords = part brands, references = DOIs of
    part-derived targets, citations = total quantity."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    s = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name")
    j = (o.join(c, o.o_custkey == c.c_custkey)
         .join(li, li.l_orderkey == o.o_orderkey)
         .join(s, li.l_suppkey == s.s_suppkey)
         .join(n, s.s_nationkey == n.n_nationkey)
         .join(p, li.l_partkey == p.p_partkey))
    ref = F.concat(F.lit("10.1000/"), ((F.col("l_partkey") * 7) % 1500).cast("string"))
    return (j.groupBy("o_orderkey", "o_orderdate", "c_mktsegment")
            .agg(F.array_sort(F.collect_set("s_name")).alias("authors"),
                 F.array_sort(F.collect_set("n_name")).alias("countries"),
                 F.array_sort(F.collect_set(F.lower("p_brand"))).alias("keywords"),
                 F.array_sort(F.collect_set(ref)).alias("refs"),
                 F.sum("l_quantity").cast("bigint").alias("citations"),
                 F.concat_ws(" ", F.array_sort(F.collect_set("p_name"))).alias("title"))
            .select(F.col("o_orderkey").alias("doc_id"), F.year("o_orderdate").cast("int").alias("year"),
                    F.col("c_mktsegment").alias("source"), "authors", "countries", "keywords", "refs",
                    "citations", F.concat(F.lit("10.1000/"), F.col("o_orderkey").cast("string")).alias("doi"),
                    "title"))


PUBS_SQL = """
select o_orderkey as doc_id, cast(year(o_orderdate) as int) as year,
  c_mktsegment as source,
  list_sort(list(distinct s_name)) as authors,
  list_sort(list(distinct n_name)) as countries,
  list_sort(list(distinct lower(p_brand))) as keywords,
  list_sort(list(distinct concat('10.1000/', cast((l_partkey*7) % 1500 as VARCHAR)))) as refs,
  cast(sum(l_quantity) as bigint) as citations,
  concat('10.1000/', cast(o_orderkey as VARCHAR)) as doi,
  array_to_string(list_sort(list(distinct p_name)), ' ') as title
from orders join customer on o_custkey=c_custkey
  join lineitem on l_orderkey=o_orderkey join supplier on l_suppkey=s_suppkey
  join nation on s_nationkey=n_nationkey join part on l_partkey=p_partkey
group by o_orderkey, o_orderdate, c_mktsegment
"""


def survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C3: Likert-style items, a reversed item, a group and pre/post scores."""
    li = read_table(spark, sf_dir, "lineitem")
    qn, ln = F.col("l_quantity"), F.col("l_linenumber")
    return li.select(
        F.col("l_orderkey").alias("okey"), ln.alias("line"),
        (qn % 5 + 1).cast("int").alias("q1"),
        ((qn + ln) % 5 + 1).cast("int").alias("q2"),
        ((qn + ln * ln) % 5 + 1).cast("int").alias("q3"),
        (6 - (qn % 5 + 1)).cast("int").alias("q4"),
        F.col("l_returnflag").alias("grp"), F.col("l_linestatus").alias("status"),
        F.col("l_extendedprice").alias("pre"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("post"),
        F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"))


SURVEY_SQL = """
select l_orderkey as okey, l_linenumber as line,
  cast(l_quantity % 5 + 1 as int) as q1,
  cast((l_quantity + l_linenumber) % 5 + 1 as int) as q2,
  cast((l_quantity + l_linenumber*l_linenumber) % 5 + 1 as int) as q3,
  cast(6 - (l_quantity % 5 + 1) as int) as q4,
  l_returnflag as grp, l_linestatus as status, l_extendedprice as pre,
  l_extendedprice*(1-l_discount) as post,
  l_quantity as quantity, l_discount as discount, l_tax as tax
from lineitem
"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4: a binary outcome with a score, for metrics without fitting."""
    e = read_table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("row_id"),
                    F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("y"),
                    F.round(F.col("value") / (F.col("value") + 50), 3).alias("score"),
                    "event_type")


SCORED_SQL = """
select event_id as row_id, case when event_type='purchase' then 1 else 0 end as y,
       round(value/(value+50),3) as score, event_type
from events
"""


def multiclass_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted vs actual classes for multiclass metrics: actual = event type,
    predicted = a deterministic rule on value buckets."""
    e = read_table(spark, sf_dir, "events")
    types = F.array(*[F.lit(t) for t in ("click", "error", "purchase", "signup", "view")])
    pred = F.element_at(types, (F.floor(F.col("value")).cast("bigint") % 5 + 1).cast("int"))
    return e.select(F.col("event_id").alias("row_id"), F.col("event_type").alias("actual"),
                    pred.alias("predicted"))


MULTICLASS_SQL = """
select event_id as row_id, event_type as actual,
  (['click','error','purchase','signup','view'])[cast(floor(value) as bigint) % 5 + 1] as predicted
from events
"""


def regression_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actual vs predicted numbers for regression metrics: the price of a line
    predicted from quantity x the part's retail price."""
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey",
                                                      "l_quantity", "l_extendedprice")
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    j = li.join(p, li.l_partkey == p.p_partkey)
    return j.select(F.col("l_extendedprice").alias("actual"),
                    (F.col("l_quantity") * F.col("p_retailprice") * 0.97).alias("predicted"))


REGRESSION_SQL = """
select l_extendedprice as actual, l_quantity * p_retailprice * 0.97 as predicted
from lineitem join part on l_partkey = p_partkey
"""


DIMS = 64  # coordinates of an embedding


def vectors(spark: SparkSession, sf_dir: str, dims: int = DIMS) -> DataFrame:
    """embeddings with their coordinates as double columns."""
    e = read_table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"x{i}")
                                         for i in range(dims)])


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings with their coordinates as one array column."""
    return read_table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))


def vectors_sql(dims: int = DIMS) -> str:
    cols = ", ".join(f"cast(embedding[{i + 1}] as double) as x{i}" for i in range(dims))
    return f"select vec_id, label, {cols} from embeddings"


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contact-style columns derived from customer rows: an e-mail, a
    formatted phone number, a name and a segment (personal-data checks)."""
    c = read_table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    email = F.when(k % 9 == 0, F.lit("unknown")).otherwise(
        F.concat(F.lower(F.regexp_replace("c_name", "#", ".")), F.lit("@example.com")))
    phone = F.concat(F.lit("+"), (F.col("c_nationkey") + 10).cast("string"), F.lit(" "),
                     F.lpad((k % 1000).cast("string"), 3, "0"), F.lit("-"),
                     F.lpad((k * 7 % 10000).cast("string"), 4, "0"))
    return c.select(k.alias("row_id"), F.col("c_name").alias("name"), email.alias("email"),
                    phone.alias("phone"), F.col("c_mktsegment").alias("segment"))


CONTACTS_SQL = """
select c_custkey as row_id, c_name as name,
  case when c_custkey % 9 = 0 then 'unknown' else concat(lower(replace(c_name, '#', '.')), '@example.com') end as email,
  concat('+', cast(c_nationkey + 10 as varchar), ' ', lpad(cast(c_custkey % 1000 as varchar), 3, '0'), '-',
         lpad(cast(c_custkey * 7 % 10000 as varchar), 4, '0')) as phone,
  c_mktsegment as segment
from customer
"""


def order_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: price, customer balance, line statistics and a
    binary target (urgent/high priority) plus the status class. Stored: splits, folds and fits
    read it many times, and none repeats the joins."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority",
                                                   "o_orderstatus")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    li = (read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey")
          .agg(F.count(F.lit(1)).alias("n_lines"), F.avg("l_discount").alias("avg_discount"),
               F.avg("l_quantity").alias("avg_quantity")))
    j = o.join(c, o.o_custkey == c.c_custkey).join(li, o.o_orderkey == li.l_orderkey)
    return cut_lineage(j.select("o_orderkey", "o_totalprice", "c_acctbal", F.col("n_lines").cast("double").alias("n_lines"),
                                "avg_discount", "avg_quantity", "c_mktsegment", "o_orderstatus",
                                F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int").cast("string").alias("urgent")))
