"""Registered queries: bibliometrics on the pubs fixture (orders as documents)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import biblio as B
from ..sources.tables import read_table
from .fixtures import PUBS_SQL, pubs
from .registry import register, rounded, sql_rounded

AS_OF = 2025  # fixed "current year" (the reference reads the clock; a parameter here)
P = f"p as ({PUBS_SQL})"


def _stops_sql():
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in B.stop_words()) + ")"


@register("biblio_overview", sql_rounded(f"""with {P},
y as (select year, count(*) as n from p where year is not null group by year),
e as (select min(year) as y0, max(year) as y1 from y),
g as (select case when max(e.y1) > max(e.y0) and max(case when y.year = e.y0 then n end) > 0 then
  (power(max(case when y.year = e.y1 then n end) * 1.0 / max(case when y.year = e.y0 then n end), 1.0 / (max(e.y1) - max(e.y0))) - 1) * 100
  end as annual_growth_rate from y, e)
select cast(count(*) as bigint) as documents, min(year) as first_year, max(year) as last_year,
  cast(count(distinct source) as bigint) as sources, avg({AS_OF} - year) as document_average_age,
  avg(citations) as average_citations_per_doc, cast(sum(citations) as bigint) as total_citations,
  cast(count_if(len(authors) = 1) as bigint) as single_authored_docs,
  avg(case when len(authors) > 0 then len(authors) end) as co_authors_per_doc,
  avg(case when len(countries) > 0 then cast(len(countries) > 1 as double) end) * 100 as international_coauthorship_percent,
  max(g.annual_growth_rate) as annual_growth_rate,
  (select cast(count(distinct r) as bigint) from (select unnest(refs) as r from p) where length(r) > 0) as "references",
  (select cast(count(distinct r) as bigint) from (select unnest(keywords) as r from p) where length(r) > 0) as author_keywords,
  cast(0 as bigint) as index_keywords,
  (select cast(count(distinct r) as bigint) from (select unnest(authors) as r from p) where length(r) > 0) as authors
from p, g""", ["document_average_age", "average_citations_per_doc", "co_authors_per_doc",
               "international_coauthorship_percent", "annual_growth_rate"]))
def q_overview(spark, sf):
    return rounded(B.overview(pubs(spark, sf), AS_OF))


@register("biblio_annual", sql_rounded(f"""with {P},
s as (select min(year) as a, max(year) as b from p where year is not null),
ys as (select unnest(range(a, b + 1)) as year from s),
g as (select year, count(*) as documents, avg(citations) as mean_citations from p where year is not null group by year)
select cast(ys.year as integer) as year, cast(coalesce(g.documents, 0) as bigint) as documents, g.mean_citations,
  g.mean_citations / ({AS_OF} - ys.year + 1) as mean_citations_per_year
from ys left join g on ys.year = g.year""", ["mean_citations", "mean_citations_per_year"]))
def q_annual(spark, sf):
    return rounded(B.annual(pubs(spark, sf), AS_OF))


@register("biblio_authors", sql_rounded(f"""with {P},
e as (select unnest(authors) as item from p),
d as (select item, count(*) as documents from e where item is not null and length(item) > 0 group by item),
fr as (select item, sum(w) as fractional from (select unnest(list_distinct(authors)) as item,
       1.0 / len(list_distinct(authors)) as w from p where len(authors) > 0) group by item)
select d.item as name, cast(d.documents as bigint) as documents, fr.fractional
from (select * from d order by documents desc, item limit 20) d left join fr on d.item = fr.item""", ["fractional"]))
def q_authors(spark, sf):
    return rounded(B.productivity_authors(pubs(spark, sf), 20))


@register("biblio_sources", f"""with {P}
select source as name, cast(count(*) as bigint) as documents from p where source is not null group by source
order by documents desc, name limit 20""")
def q_sources(spark, sf):
    return B.productivity_sources(pubs(spark, sf), 20)


@register("biblio_countries", f"""with {P},
e as (select unnest(countries) as name, len(countries) > 1 as multi from p)
select name, cast(count(*) as bigint) as documents, cast(count_if(not multi) as bigint) as single_country,
  cast(count_if(multi) as bigint) as multi_country from e group by name order by documents desc, name limit 20""")
def q_countries(spark, sf):
    return B.productivity_countries(pubs(spark, sf), 20)


@register("biblio_completeness", sql_rounded(f"""with {P}
select 'year' as field, avg(cast(year is not null as double)) * 100 as percent from p
union all select 'source', avg(cast(source is not null and trim(source) <> '' as double)) * 100 from p
union all select 'authors', avg(cast(coalesce(len(authors) > 0, false) as double)) * 100 from p
union all select 'countries', avg(cast(coalesce(len(countries) > 0, false) as double)) * 100 from p
union all select 'keywords', avg(cast(coalesce(len(keywords) > 0, false) as double)) * 100 from p
union all select 'refs', avg(cast(coalesce(len(refs) > 0, false) as double)) * 100 from p
union all select 'citations', avg(cast(citations is not null as double)) * 100 from p
union all select 'doi', avg(cast(doi is not null and trim(doi) <> '' as double)) * 100 from p
union all select 'title', avg(cast(title is not null and trim(title) <> '' as double)) * 100 from p""", ["percent"]))
def q_completeness(spark, sf):
    return rounded(B.completeness(pubs(spark, sf)))


IMPACT_SQL = f"""with {P},
a as (select distinct doc_id, unnest(list_distinct(authors)) as author, coalesce(citations, 0) as c, year from p),
r as (select author, c, year, row_number() over (partition by author order by c desc) as rn,
      sum(c) over (partition by author order by c desc rows between unbounded preceding and current row) as cs
      from a where author is not null and length(author) > 0)
select author, cast(count(*) as bigint) as documents, cast(sum(c) as bigint) as total_citations,
  cast(count_if(c >= rn) as bigint) as h_index, cast(coalesce(max(case when cs >= rn * rn then rn end), 0) as bigint) as g_index,
  cast(count_if(c >= 10) as bigint) as i10_index, count_if(c >= rn) / ({AS_OF} - min(year) + 1) as m_index,
  cast(min(year) as integer) as first_year
from r group by author"""


@register("biblio_author_impact", sql_rounded(IMPACT_SQL + " order by h_index desc, total_citations desc, author limit 20",
                                              ["m_index"]))
def q_impact(spark, sf):
    return rounded(B.author_impact(pubs(spark, sf), AS_OF, 20))


@register("biblio_author_impact_all", sql_rounded(IMPACT_SQL, ["m_index"]))
def q_impact_all(spark, sf):
    return rounded(B.author_impact(pubs(spark, sf), AS_OF, None))


LOCAL_SQL = f"""with {P},
c as (select distinct doc_id, regexp_replace(d, '\\.+$', '') as doi from (
        select doc_id, unnest(regexp_extract_all(lower(r), '(10\\.\\d{{4,9}}/[^\\s;,]+)', 1)) as d
        from (select doc_id, unnest(refs) as r from p))),
t as (select lower(doi) as doi, max(doc_id) as target from p where doi is not null and doi <> '' group by 1),
h as (select target, count(*) as local_citations from c join t on c.doi = t.doi group by target)"""


@register("biblio_local_citations", LOCAL_SQL + """
select p.doc_id, cast(coalesce(h.local_citations, 0) as bigint) as local_citations from p left join h on p.doc_id = h.target""")
def q_local(spark, sf):
    return B.local_citations(pubs(spark, sf))


@register("biblio_most_cited", sql_rounded(LOCAL_SQL + f"""
select p.doc_id, p.year, p.source, p.authors[1] as first_author, cast(p.citations as bigint) as citations,
  p.citations / ({AS_OF} - p.year + 1) as citations_per_year, cast(coalesce(h.local_citations, 0) as bigint) as local_citations,
  p.doi
from (select * from p order by citations desc nulls last, doc_id limit 20) p left join h on p.doc_id = h.target""",
                                           ["citations_per_year"]))
def q_most_cited(spark, sf):
    return rounded(B.most_cited(pubs(spark, sf), AS_OF, 20))


@register("biblio_word_cloud_keywords", f"""with {P},
e as (select unnest(list_distinct(keywords)) as word from p)
select word, cast(count(*) as bigint) as count from e where length(word) > 0 group by word
order by count desc, word limit 60""")
def q_cloud_kw(spark, sf):
    return B.word_cloud(pubs(spark, sf), "keywords", 60)


def _title_words_sql(alias="p"):
    return (f"list_sort(list_distinct(list_filter(regexp_extract_all(lower(coalesce({alias}.title, '')), "
            f"'([a-z][a-z-]{{2,}})', 1), lambda x: x not in {_stops_sql()})))")


@register("biblio_word_cloud_title", f"""with {P},
e as (select unnest({_title_words_sql()}) as word from p)
select word, cast(count(*) as bigint) as count from e where length(word) > 0 group by word
order by count desc, word limit 60""")
def q_cloud_title(spark, sf):
    return B.word_cloud(pubs(spark, sf), "title", 60)


@register("text_word_counts_documents", f"""
with w as (select unnest(regexp_extract_all(lower(text), '([a-z][a-z-]{{2,}})', 1)) as word from documents)
select word, cast(count(*) as bigint) as count from w where word not in {_stops_sql()}
group by word order by count desc, word limit 20""")
def q_word_counts(spark, sf):
    return B.word_counts(read_table(spark, sf, "documents"), "text", 20)


@register("biblio_trending_keywords", sql_rounded(f"""with {P},
e as (select distinct doc_id, unnest(list_distinct(keywords)) as term, cast(year as double) as y from p where year is not null),
t as (select term, count(*) as frequency, quantile_cont(y, 0.25) as q1, quantile_cont(y, 0.5) as median,
      quantile_cont(y, 0.75) as q3 from e group by term having count(*) >= 5),
r as (select *, cast(round_even(median, 0) as integer) as median_year,
      row_number() over (partition by cast(round_even(median, 0) as integer) order by frequency desc, term) as rn from t)
select term, cast(frequency as bigint) as frequency, q1, median, q3, median_year from r where rn <= 3""",
                                                 ["q1", "median", "q3"]))
def q_trending(spark, sf):
    return rounded(B.trending_terms(pubs(spark, sf), "keywords", 5, 3))


def _cooc_sql(list_expr, top_n, min_weight=1, min_freq=1):
    return f"""with {P},
e as (select distinct doc_id, unnest({list_expr}) as item from p),
e2 as (select * from e where item is not null and length(item) > 0),
f as (select item, count(*) as freq from e2 group by item having count(*) >= {min_freq}),
t as (select item from f order by freq desc, item limit {top_n}),
et as (select e2.* from e2 join t on e2.item = t.item)
select a.item as a, b.item as b, cast(count(*) as bigint) as weight
from et a join et b on a.doc_id = b.doc_id and a.item < b.item group by 1, 2 having count(*) >= {min_weight}"""


@register("biblio_cooccurrence_keywords", _cooc_sql("keywords", 50))
def q_cooc_kw(spark, sf):
    p = pubs(spark, sf)
    return B.cooccurrence(p, B.keyword_list(p, "keywords"), 50)[1]


@register("biblio_coauthor_edges", _cooc_sql("authors", 50, min_weight=2))
def q_coauthor(spark, sf):
    p = pubs(spark, sf)
    return B.cooccurrence(p, B.keyword_list(p, "authors"), 50, 1, 2)[1]


@register("biblio_country_edges", _cooc_sql("countries", 50))
def q_country(spark, sf):
    p = pubs(spark, sf)
    return B.cooccurrence(p, B.keyword_list(p, "countries"), 50)[1]


@register("biblio_cocitation_edges",
          _cooc_sql("list_transform(refs, lambda r: regexp_replace(regexp_replace(lower(trim(r)), '\\s+', ' ', 'g'), "
                    "'[.;, ]+$', ''))", 50))
def q_cocitation(spark, sf):
    from ..functions.text import ref_key
    p = pubs(spark, sf)
    return B.cooccurrence(p, F.transform("refs", lambda r: ref_key(r)), 50)[1]


@register("biblio_title_word_edges", _cooc_sql(_title_words_sql(), 30))
def q_title_edges(spark, sf):
    p = pubs(spark, sf)
    return B.cooccurrence(p, B.keyword_list(p, "title"), 30)[1]


@register("biblio_coupling_edges", f"""with {P},
k as (select doc_id, citations, list_distinct(list_transform(refs, lambda r: regexp_replace(regexp_replace(lower(trim(r)),
      '\\s+', ' ', 'g'), '[.;, ]+$', ''))) as rk from p),
d as (select doc_id from k where len(rk) > 0 order by coalesce(citations, 0) desc, doc_id limit 50),
e as (select distinct k.doc_id, unnest(k.rk) as ref from k join d on k.doc_id = d.doc_id)
select a.doc_id as a, b.doc_id as b, cast(count(*) as bigint) as weight
from e a join e b on a.ref = b.ref and a.doc_id < b.doc_id group by 1, 2""")
def q_coupling(spark, sf):
    return B.coupling(pubs(spark, sf), 50)[1]


@register("biblio_equivalence_keywords", sql_rounded(f"""with {P},
e as (select distinct doc_id, unnest(keywords) as item from p),
f as (select item, count(*) as freq from e group by item),
t as (select item, freq from f order by freq desc, item limit 50),
et as (select e.* from e join t on e.item = t.item),
w as (select a.item as a, b.item as b, count(*) as weight from et a join et b on a.doc_id = b.doc_id and a.item < b.item
      group by 1, 2)
select w.a, w.b, cast(w.weight as bigint) as weight, power(w.weight, 2) / (fa.freq * fb.freq) as e
from w join t fa on w.a = fa.item join t fb on w.b = fb.item""", ["e"]))
def q_equivalence(spark, sf):
    p = pubs(spark, sf)
    nodes, edges = B.cooccurrence(p, B.keyword_list(p, "keywords"), 50)
    return rounded(B.equivalence(nodes, edges))


@register("biblio_modularity_regions", sql_rounded(f"""with {P},
e as (select distinct doc_id, unnest(countries) as item from p),
t as (select item from (select item, count(*) as freq from e group by item) order by freq desc, item limit 50),
et as (select e.* from e join t on e.item = t.item),
w as (select a.item as a, b.item as b, count(*) as weight from et a join et b on a.doc_id = b.doc_id and a.item < b.item
      group by 1, 2),
lab as (select n_name as node, n_regionkey as community from nation),
j as (select w.weight, la.community as ca, lb.community as cb from w join lab la on w.a = la.node join lab lb on w.b = lb.node),
deg as (select ca as c, weight as w from j union all select cb, weight from j),
dc as (select c, sum(w) as d from deg group by c),
lc as (select ca as c, sum(weight) as l from j where ca = cb group by ca),
m as (select sum(weight) as m from j)
select sum(coalesce(lc.l, 0) / m.m - power(dc.d / (2 * m.m), 2)) as modularity
from dc left join lc on dc.c = lc.c, m""", ["modularity"]))
def q_modularity(spark, sf):
    p = pubs(spark, sf)
    _, edges = B.cooccurrence(p, B.keyword_list(p, "countries"), 50)
    labels = read_table(spark, sf, "nation").select(F.col("n_name").alias("node"),
                                                    F.col("n_regionkey").alias("community"))
    return rounded(B.modularity(edges, labels))


@register("biblio_inclusion_links", sql_rounded(f"""with {P},
th as (select distinct year - 1992 as period, source as theme, unnest(keywords) as word from p where year is not null),
sz as (select period, theme, count(distinct word) as size from th group by 1, 2),
sh as (select a.period as pa, a.theme as ta, b.period as pb, b.theme as tb, count(*) as shared
       from th a join th b on b.period = a.period + 1 and a.word = b.word group by 1, 2, 3, 4)
select cast(sh.pa as integer) as from_period, sh.ta as from_theme, cast(sh.pb as integer) as to_period, sh.tb as to_theme,
  cast(sh.shared as bigint) as shared, sh.shared / least(sa.size, sb.size) as inclusion
from sh join sz sa on sa.period = sh.pa and sa.theme = sh.ta join sz sb on sb.period = sh.pb and sb.theme = sh.tb""",
                                               ["inclusion"]))
def q_inclusion(spark, sf):
    p = pubs(spark, sf)
    themes = p.where(F.col("year").isNotNull()).select((F.col("year") - 1992).cast("int").alias("period"),
                                                       F.col("source").alias("theme"),
                                                       F.explode("keywords").alias("word"))
    return rounded(B.inclusion_links(themes))


def _three_field_sql():
    def tops(expr, n=10):
        return (f"(select item from (select item, count(*) as f from (select distinct doc_id, unnest({expr}) as item "
                f"from p) where item is not null and length(item) > 0 group by item order by f desc, item limit {n}))")
    srcs = "case when source is not null and source <> '' then [source] else [] end"
    fields = ["authors", "keywords", srcs]
    parts = []
    for side in (0, 1):
        l_expr, r_expr = fields[side], fields[side + 1]
        parts.append(f"""select {side} as from_field, l.item as src, {side + 1} as to_field, r.item as dst,
  cast(count(*) as bigint) as weight
from (select distinct doc_id, unnest({l_expr}) as item from p) l
join (select distinct doc_id, unnest({r_expr}) as item from p) r on l.doc_id = r.doc_id
where l.item in {tops(l_expr)} and r.item in {tops(r_expr)} group by 1, 2, 3, 4""")
    return f"with {P} " + " union all ".join(parts)


@register("biblio_three_field", _three_field_sql())
def q_three_field(spark, sf):
    return B.three_field(pubs(spark, sf), ("authors", "keywords", "source"), 10)


@register("biblio_network_communities")
def q_network(spark, sf):
    nodes, _ = B.network(pubs(spark, sf), "country", 50)
    return nodes


@register("biblio_coupling_network")
def q_coupling_net(spark, sf):
    nodes, _ = B.network(pubs(spark, sf), "coupling", 50)
    return nodes


@register("biblio_thematic_map")
def q_thematic(spark, sf):
    return rounded(B.thematic_map(pubs(spark, sf), "keywords", 250, 5).drop("words"))


@register("biblio_evolution_links")
def q_evolution(spark, sf):
    _, links = B.evolution(pubs(spark, sf), "keywords", None, 2)
    return rounded(links)


@register("biblio_institutions")
def q_institutions(spark, sf):
    """AGG-13 institutions over affiliations built from supplier + nation
    names (no marker word -> none found; the parsing is what is exercised)."""
    p = pubs(spark, sf).withColumn(
        "affiliations", F.transform("countries", lambda c: F.concat(F.lit("Dept. of Trade, University of "), c,
                                                                   F.lit(", "), c)))
    return B.productivity_institutions(p, 20)
