"""Registered queries: readers, sinks and streaming replay.

Each reader query first writes data that Spark derives from the given tables
(a semicolon CSV with decimal commas, a Scopus-style export, Web of Science
plain text, MEDLINE) into the shared checkpoint folder, then reads it back
with the reader under test.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.prep import fit_prep, split
from ..sources import files as S
from ..sources import publications as P
from ..sources.tables import read_table
from ..streaming.replay import file_stream, replay_stream, run_to_table
from .fixtures import PUBS_SQL, pubs
from .registry import register, rounded, sql_rounded


def _tmp(spark, name):
    return S.scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


@register("src_semicolon_decimal_csv", sql_rounded("""
select o_orderkey as row_id, o_orderpriority as priority, round(o_totalprice, 2) as price from orders""", ["price"]))
def q_semicolon(spark, sf):
    o = read_table(spark, sf, "orders")
    path = _tmp(spark, "semicolon")
    (o.select(F.col("o_orderkey").alias("row_id"), F.col("o_orderpriority").alias("priority"),
              F.replace(F.round("o_totalprice", 2).cast("string"), F.lit("."), F.lit(",")).alias("price"))
     .write.option("header", True).option("sep", ";").csv(path))
    df, notes = S.read_delimited(spark, path)
    if "price: decimal commas read as numbers" not in notes:
        raise AssertionError(f"decimal commas not detected: {notes}")
    return rounded(df.select(F.col("row_id").cast("long"), "priority", "price"))


def _authors_str(c):
    return F.array_join(c, "; ")


@register("src_scopus_csv", f"""with p as ({PUBS_SQL})
select title, year, source, array_to_string(authors, '; ') as authors, array_to_string(keywords, '; ') as keywords,
  citations, doi, cast(len(refs) as bigint) as n_refs, array_to_string(countries, '; ') as countries from p""")
def q_scopus(spark, sf):
    p = pubs(spark, sf)
    path = _tmp(spark, "scopus")
    (p.select(_authors_str("authors").alias("Authors"), F.col("title").alias("Title"), F.col("year").alias("Year"),
              F.col("source").alias("Source title"), F.col("citations").alias("Cited by"), F.col("doi").alias("DOI"),
              _authors_str("keywords").alias("Author Keywords"), _authors_str("refs").alias("References"),
              _authors_str("countries").alias("Country of Research Organization"))
     .write.option("header", True).csv(path))
    if P.detect_format(spark, path) not in ("scopus", "csv"):
        raise AssertionError("format detection failed")
    t = P.normalise_publications(P.read_publications_table(spark, path))
    return t.select("title", "year", "source", _authors_str("authors").alias("authors"),
                    _authors_str("keywords").alias("keywords"), F.col("citations").cast("long").alias("citations"),
                    "doi", F.size("refs").cast("long").alias("n_refs"), _authors_str("countries").alias("countries"))


def _wos_records(p):
    def tag(t, arr):
        return F.when(F.size(arr) > 0, F.concat(F.lit(f"{t} "), F.array_join(arr, "\n   "), F.lit("\n"))).otherwise("")
    return p.select(F.concat(
        F.lit("PT J\n"), tag("AU", F.col("authors")), F.lit("TI "), F.col("title"), F.lit("\n"),
        F.lit("SO "), F.col("source"), F.lit("\n"), tag("DE", F.array(F.array_join("keywords", "; "))),
        tag("C1", F.transform("countries", lambda c: F.concat(F.lit("[Anon] Dept Trade, "), c))),
        tag("CR", F.col("refs")), F.lit("TC "), F.col("citations").cast("string"), F.lit("\n"),
        F.lit("PY "), F.col("year").cast("string"), F.lit("\n"), F.lit("DI "), F.col("doi"), F.lit("\nER\n"))
        .alias("value"))


@register("src_wos_plain", f"""with p as ({PUBS_SQL})
select title, cast(year as varchar) as year, source, array_to_string(authors, '; ') as authors,
  cast(citations as varchar) as citations, doi, cast(len(refs) as bigint) as n_refs, array_to_string(keywords, '|') as keywords,
  array_to_string(list_transform(countries, lambda c: 'Dept Trade, ' || c), '; ') as affiliations from p""")
def q_wos(spark, sf):
    path = _tmp(spark, "wos")
    _wos_records(pubs(spark, sf)).write.text(path)
    w = P.read_wos_plain(spark, path)
    return w.select("title", "year", "source", _authors_str("authors").alias("authors"), "citations", "doi",
                    F.size("references").cast("long").alias("n_refs"), F.array_join("keywords", "|").alias("keywords"),
                    _authors_str("affiliations").alias("affiliations"))


@register("src_wos_tab", f"""with p as ({PUBS_SQL})
select title, year, array_to_string(authors, '|') as authors, array_to_string(keywords, '|') as keywords, cast(citations as bigint) as citations,
  cast(len(refs) as bigint) as n_refs, array_to_string(list_transform(countries, lambda c: 'Dept Trade, ' || c), '|') as affiliations from p""")
def q_wos_tab(spark, sf):
    """SRC-10: lists by ";" with names in brackets before each affiliation."""
    path = _tmp(spark, "wos-tab")
    (pubs(spark, sf).select(F.lit("J").alias("PT"), _authors_str("authors").alias("AU"), F.col("title").alias("TI"), F.col("source").alias("SO"),
                            _authors_str("keywords").alias("DE"), _authors_str(F.transform("countries", lambda c: F.concat(F.lit("[A, B; C, D] Dept Trade, "), c))).alias("C1"),
                            _authors_str("refs").alias("CR"), F.col("citations").alias("TC"), F.col("year").alias("PY"), F.col("doi").alias("DI"))
     .write.option("header", True).option("sep", "\t").option("quote", "").csv(path))
    if P.detect_format(spark, path) != "wos_tab":
        raise AssertionError("format detection failed")
    t = P.read_publications(spark, path)
    return t.select("title", "year", F.array_join("authors", "|").alias("authors"), F.array_join("keywords", "|").alias("keywords"), F.col("citations").cast("long").alias("citations"),
                    F.size("refs").cast("long").alias("n_refs"), F.array_join("affiliations", "|").alias("affiliations"))


WORKS_SQL = f"""with p as ({PUBS_SQL})
select title, year, source, array_to_string(authors, '|') as authors, cast(citations as bigint) as citations, doi, cast(len(refs) as bigint) as n_refs,
  array_to_string({{}}, '|') as more from p"""


def _works(t, more):
    return t.select("title", "year", "source", F.array_join("authors", "|").alias("authors"), F.col("citations").cast("long").alias("citations"), "doi",
                    F.size("refs").cast("long").alias("n_refs"), F.array_join(more, "|").alias("more"))


@register("src_crossref_json", WORKS_SQL.format("list_transform(countries, lambda c: 'Dept Trade, ' || c)"))
def q_crossref(spark, sf):
    """SRC-12: one work per JSON document, references as text or as a DOI."""
    path = _tmp(spark, "crossref")
    author = F.transform("authors", lambda a, i: F.struct(a.alias("name"), F.when(i == 0, F.transform("countries", lambda c: F.struct(F.concat(F.lit("Dept Trade, "), c).alias("name")))).alias("affiliation")))
    (pubs(spark, sf).select(F.array("title").alias("title"), F.array("source").alias("container-title"), F.col("doi").alias("DOI"), F.col("citations").alias("is-referenced-by-count"),
                            F.struct(F.array(F.array("year")).alias("date-parts")).alias("published"), author.alias("author"),
                            F.transform("refs", lambda r: F.struct(r.alias("unstructured"))).alias("reference")).write.json(path))
    return _works(P.normalise_publications(P.read_works_json(spark, path, lines=True)), "affiliations")


PAGE_WORKS = 100
EXPORT_ROWS = 100_000  # about as many rows in a file of an export


@register("src_openalex_json", WORKS_SQL.format("list_sort(list_distinct(countries))"))
def q_openalex(spark, sf):
    """SRC-13: list responses, countries from the authorships."""
    path = _tmp(spark, "openalex")
    ship = F.transform("authors", lambda a, i: F.struct(F.struct(a.alias("display_name")).alias("author"), F.when(i == 0, F.col("countries")).alias("countries")))
    work = F.struct(F.col("title"), F.col("year").alias("publication_year"), F.struct(F.struct(F.col("source").alias("display_name")).alias("source")).alias("primary_location"),
                    ship.alias("authorships"), F.col("citations").alias("cited_by_count"), F.concat(F.lit("https://doi.org/"), "doi").alias("doi"), F.col("refs").alias("referenced_works"))
    works = pubs(spark, sf)
    pages = max(1, works.count() // PAGE_WORKS)  # so many works a page, however many there are
    (works.groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(pages)).alias("page")).agg(F.collect_list(work).alias("results")).select("results").write.json(path))
    return _works(P.normalise_publications(P.read_works_json(spark, path, lines=True)), "countries")


@register("src_dimensions_preamble", f"""with p as ({PUBS_SQL}) select title, year, array_to_string(authors, '|') as authors, doi from p""")
def q_dimensions(spark, sf):
    """SRC-14 + SRC-08: a note line above the header; a separator per value."""
    path = _tmp(spark, "dimensions")
    names = F.when(F.col("doc_id") % 2 == 0, F.array_join("authors", "| ")).otherwise(_authors_str("authors"))
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c.cast("string"), F.lit('"'), F.lit('""')), F.lit('"'))
    row = F.concat_ws(",", *[quoted(c) for c in (F.col("title"), F.col("year"), names, F.col("doi"))])
    rows = pubs(spark, sf).select(row.alias("value"))
    files = 1 + read_table(spark, sf, "orders").count() // EXPORT_ROWS
    head = spark.range(files).select(F.lit('"About the data: Exported on Jan 1"\nTitle,PubYear,Authors,DOI').alias("value"), F.lit(0).alias("o"), F.col("id").alias("file"))
    rows = rows.select("value", F.lit(1).alias("o"), F.pmod(F.xxhash64("value"), F.lit(files)).alias("file"))
    # as exports come: files of a bounded size, each with its note and header
    head.union(rows).repartition(files, "file").sortWithinPartitions("o").select("value").write.text(path)
    t = P.read_publications(spark, path)
    return t.select("title", "year", F.array_join("authors", "|").alias("authors"), "doi")


@register("src_pubmed", f"""with p as ({PUBS_SQL})
select title, cast(year as varchar) as year, source, array_to_string(authors, '; ') as authors,
  case when doc_id % 3 = 0 then null else doi end as doi, array_to_string(list_sort(list_distinct(keywords)), '; ') as mesh from p""")
def q_pubmed(spark, sf):
    p = pubs(spark, sf)
    path = _tmp(spark, "pubmed")
    rec = p.select(F.concat(
        F.lit("PMID- "), F.col("doc_id").cast("string"), F.lit("\nTI  - "), F.regexp_replace("title", " ", "\n      "),
        F.lit("\nDP  - "), F.col("year").cast("string"), F.lit(" Jan"), F.lit("\nJT  - "), F.col("source"),
        F.concat(*[F.lit("")]), F.array_join(F.transform("authors", lambda a: F.concat(F.lit("\nAU  - "), a)), ""),
        F.array_join(F.transform("keywords", lambda k: F.concat(F.lit("\nMH  - *"), k, F.lit("/metabolism"))), ""),
        F.when(F.col("doc_id") % 3 > 0, F.concat(F.when(F.col("doc_id") % 3 == 1, "\nLID - ").otherwise("\nAID - "), F.col("doi"), F.lit(" [doi]"))).otherwise(""),
        F.lit("\n")).alias("value"))
    rec.write.option("lineSep", "\n\n").text(path)
    m = P.read_pubmed(spark, path)
    return m.select("title", "year", "source", _authors_str("authors").alias("authors"), "doi",
                    F.array_join(F.array_sort("index_keywords"), "; ").alias("mesh"))


@register("snk_prepared_roundtrip", """
with o as (select o_orderkey, o_orderpriority, row_number() over (partition by o_orderpriority
  order by md5(concat_ws('|', '42', cast(o_orderkey as varchar)))) as r, count(*) over (partition by o_orderpriority) as n
  from orders)
select case when r <= round_even(n * 0.2, 0) then 'test' else 'train' end as __split__, cast(count(*) as bigint) as rows
from o group by 1""")
def q_sink(spark, sf):
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    path = _tmp(spark, "prepared")
    S.write_prepared(split(o, "o_orderkey", 0.2, 42, "o_orderpriority"), path)
    back = spark.read.parquet(path)
    return back.groupBy("__split__").agg(F.count(F.lit(1)).alias("rows"))


EVENT_PLAN = {"value": [{"op": "impute", "strategy": "median"}, {"op": "scale", "method": "standard"}],
              "event_type": [{"op": "encode", "method": "onehot"}]}
TYPES = ["click", "error", "purchase", "signup", "view"]


@register("str_replay_events", sql_rounded(f"""
with s as (select quantile_cont(value, 0.5) as med from events),
m as (select avg(coalesce(value, (select med from s))) as mu, stddev_pop(coalesce(value, (select med from s))) as sd
      from events)
select event_id, (coalesce(value, (select med from s)) - m.mu) / m.sd as value,
  {', '.join(f"cast(coalesce(event_type = '{t}', false) as bigint) as event_type_{t}" for t in TYPES)}
from events, m""", ["value"]))
def q_stream(spark, sf):
    """STR-01: state fitted on the batch table, replayed on a file stream of
    the same table; the stream is drained into the shared folder."""
    e = read_table(spark, sf, "events").select("event_id", "value", "event_type")
    state = fit_prep(e, EVENT_PLAN)
    stream = file_stream(spark, sf, "events", read_table(spark, sf, "events").schema).select(
        "event_id", "value", "event_type")
    out = run_to_table(spark, replay_stream(state, stream), "events", uuid.uuid4().hex[:12])
    return rounded(out)


@register("str_score_events")
def q_score_stream(spark, sf):
    """STR-02: a fitted spark.ml pipeline scoring the events stream."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    e = read_table(spark, sf, "events").select("event_id", "value", "user_id", "event_type").dropna()
    train = e.withColumn("label", (F.col("event_type") == "purchase").cast("double"))
    model = Pipeline(stages=[VectorAssembler(inputCols=["value", "user_id"], outputCol="features"),
                             LogisticRegression(maxIter=20)]).fit(train)
    stream = file_stream(spark, sf, "events", read_table(spark, sf, "events").schema).select(
        "event_id", "value", "user_id").dropna()
    from ..streaming.replay import score_stream
    scored = score_stream(model, stream).select("event_id", "prediction")
    return run_to_table(spark, scored, "scores", uuid.uuid4().hex[:12])
