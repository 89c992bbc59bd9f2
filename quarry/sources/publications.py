"""Publication exports (SRC-07..15): format detection, tagged text, tables and API JSON,
all to the same columns.

Tagged formats are read one record per row (the record separator is the text source's
line separator); continuation lines are folded by one replacement, so a record is a list
of "TAG value" lines and everything else is column expressions. JSON is read with an
explicit schema, so no inference pass takes place.
"""

from __future__ import annotations

import csv
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalise_doi, split_list, year_of
from .files import head_lines, read_delimited, sniff_delimiter

# fixed values: canonical field -> column names of the exports (case-insensitive)
ALIASES = {
    "title": ["title", "article title", "document title", "display_name"],
    "year": ["year", "pubyear", "publication year", "publication_year", "py"],
    "source": ["source title", "source", "journal", "source_title", "publication venue", "venue",
               "source title/anthology title", "primary_location.source.display_name", "so"],
    "authors": ["authors", "author", "author names", "authorships.author.display_name", "au"],
    "affiliations": ["affiliations", "author affiliations", "authors affiliations", "institutions",
                     "authorships.institutions.display_name", "c1", "research organizations - standardized",
                     "authors affiliations - name of research organization"],
    "countries": ["country of research organization", "authors affiliations - country of research organization",
                  "countries", "authorships.countries"],
    "keywords": ["author keywords", "keywords", "de", "mesh terms"],
    "index_keywords": ["index keywords", "keywords plus", "concepts.display_name", "id"],
    "citations": ["cited by", "times cited", "citations", "cited_by_count", "citation count", "tc", "times_cited"],
    "references": ["references", "cited references", "cr", "referenced_works"],
    "doi": ["doi"],
    "doc_type": ["document type", "type", "publication type", "dt", "pt"],
}
LIST_FIELDS = ["authors", "affiliations", "countries", "keywords", "index_keywords", "references"]
# fixed values: the exports' field tags
WOS_TAGS = {"title": "TI", "year": "PY", "source": "SO", "authors": "AU", "affiliations": "C1", "keywords": "DE",
            "index_keywords": "ID", "citations": "TC", "references": "CR", "doi": "DI", "doc_type": "DT"}
WOS_LINES = {"authors", "affiliations", "references"}  # one value a line; other tags wrap
WOS_TAB_HEADER = {"PT", "AU", "TI", "SO"}
SCOPUS_HEADER = {"authors", "source title", "cited by"}
# fixed values: spellings of the same country seen in exports -> one name
COUNTRY_ALIASES = {"united states": "USA", "united states of america": "USA", "u.s.a.": "USA", "us": "USA",
                   "usa": "USA", "united kingdom": "UK", "england": "UK", "scotland": "UK", "wales": "UK",
                   "northern ireland": "UK", "uk": "UK", "peoples r china": "China",
                   "people's republic of china": "China", "china": "China", "south korea": "South Korea",
                   "korea": "South Korea", "republic of korea": "South Korea", "russian federation": "Russia",
                   "russia": "Russia", "iran": "Iran", "islamic republic of iran": "Iran",
                   "viet nam": "Vietnam", "vietnam": "Vietnam", "turkiye": "Turkey", "turkey": "Turkey"}

STRINGS = "array<string>"
_DATE = "struct<`date-parts`: array<array<int>>>"
_DATES = ["issued", "published-print", "published-online", "published", "created"]
CROSSREF = ("title array<string>, `container-title` array<string>, subject array<string>, DOI string, type string, `is-referenced-by-count` long, "
            + ", ".join(f"`{d}` {_DATE}" for d in _DATES)
            + ", author array<struct<name: string, family: string, given: string, affiliation: array<struct<name: string>>>>"
            ", reference array<struct<DOI: string, unstructured: string, author: string, year: string, `journal-title`: string, volume: string, `first-page`: string>>")
_NAMED = "array<struct<display_name: string>>"
OPENALEX = ("display_name string, publication_year int, cited_by_count long, referenced_works array<string>, doi string, "
            f"primary_location struct<source: struct<display_name: string>>, keywords {_NAMED}, topics {_NAMED}, concepts {_NAMED}, "
            "authorships array<struct<author: struct<display_name: string>, raw_affiliation_strings: array<string>, "
            f"institutions: {_NAMED}, countries: array<string>>>")


# ---- which export is it -----------------------------------------------------

def _header(line: str, sep: str) -> set[str]:
    return {c.strip().strip('"') for c in line.split(sep)}


#: First rule that holds for the first lines decides; a table with other columns is "csv".
FORMATS = [
    ("json", lambda first, text: re.match(r"\s*[\[{]", text)),
    ("pubmed", lambda first, text: re.match(r"\s*PMID *- ", text)),
    ("wos_tab", lambda first, text: WOS_TAB_HEADER <= _header(first, "\t") and first.count("\t") > 4),
    ("wos_plain", lambda first, text: re.match(r"(FN|VR|PT) ", first)),
    ("scopus", lambda first, text: SCOPUS_HEADER <= _header(first.lower(), ",")),
]


def detect_format(spark: SparkSession, path: str) -> str:
    """SRC-07: json, pubmed, wos_tab, wos_plain, scopus or csv, from the first lines."""
    lines = head_lines(spark, path, 20)
    first = lines[0].lstrip("﻿") if lines else ""
    return next((name for name, holds in FORMATS if holds(first, "\n".join([first, *lines[1:]]))), "csv")


def read_publications(spark: SparkSession, path: str) -> DataFrame:
    """Any supported export, detected and normalised (SRC-07 + SRC-15)."""
    kind = detect_format(spark, path)
    readers = {"json": read_works_json, "pubmed": read_pubmed, "wos_tab": read_wos_tab, "wos_plain": read_wos_plain,
               "scopus": lambda s, p: read_publications_table(s, p, any_columns=True), "csv": read_publications_table}
    return normalise_publications(readers[kind](spark, path))


# ---- tables -------------------------------------------------------------------

def match_columns(df: DataFrame) -> DataFrame:
    """SRC-05: canonical field <- first alias present (case-insensitive, trimmed); missing
    fields become typed nulls."""
    at = {c.strip().lower(): c for c in reversed(df.columns)}
    found = {field: next((at[n] for n in names if n in at), None) for field, names in ALIASES.items()}
    return df.select(*[(F.col(f"`{c}`") if c else F.lit(None)).cast("string").alias(field) for field, c in found.items()])


def _parts(value: Column) -> Column:
    """A list cell: by ";", or by "|" where only that occurs in the value."""
    return F.when(value.contains("|") & ~value.contains(";"), split_list(value, r"\|")).otherwise(split_list(value, ";"))


def skip_preamble(spark: SparkSession, path: str) -> DataFrame | None:
    """SRC-14: the table below a note line, None where the first line is the header. A note
    says "about the data" or has less than half of the cells of the line after it."""
    lines = head_lines(spark, path, 3)
    if len(lines) < 2:
        return None
    sep = sniff_delimiter(lines[1:2])
    note, names = (next(csv.reader([x.lstrip("﻿")], delimiter=sep), []) for x in lines[:2])
    told = bool(note) and note[0].strip().lower().startswith("about the data")
    if not told and not (len(names) > 2 and 2 * len(note) < len(names)):
        return None
    cells = [f"c{i}" for i in range(len(names))]
    rows = spark.read.schema(", ".join(f"{c} string" for c in cells)).option("sep", sep).option("multiLine", True).csv(path)
    same = lambda row: F.concat_ws("\x01", *[F.coalesce(F.col(c), F.lit("")) for c in cells]) == "\x01".join([*row, *[""] * len(cells)][:len(cells)])
    return rows.where(~same(names) & ~same(note)).toDF(*names)


def read_publications_table(spark: SparkSession, path: str, sep: str | None = None, any_columns: bool = False) -> DataFrame:
    """SRC-08: Scopus, Dimensions or any table with known column names. Unless
    ``any_columns``, a table without a title or without a year is refused."""
    df = skip_preamble(spark, path)
    m = match_columns(read_delimited(spark, path, sep)[0] if df is None else df)
    if not any_columns:
        seen = m.agg(F.count("title").alias("title"), F.count("year").alias("year")).first()
        if lacking := [c for c in ("title", "year") if not seen[c]]:
            raise ValueError(f"not a publication table: no {' and no '.join(lacking)}")
    return m.withColumns({c: _parts(F.col(c)) for c in LIST_FIELDS})


# ---- tagged text -----------------------------------------------------------------

def _records(spark: SparkSession, path: str, end: str, fold: tuple[str, str], line: str) -> DataFrame:
    """(lines): array<struct<t, v>> per record. ``fold`` joins continuation lines to their
    tag's line, ``line`` has the tag and the value as groups."""
    windows = any(x.endswith("\r") for x in head_lines(spark, path, 5, keep_returns=True))
    text = F.regexp_replace(F.col("value"), "\r", "") if windows else F.col("value")
    end = end.replace("\n", "\r\n") if windows else end
    folded = F.split(F.regexp_replace(text, *fold), "\n")
    lines = F.transform(F.filter(folded, lambda x: x.rlike(line)),
                        lambda x: F.struct(F.regexp_extract(x, line, 1).alias("t"), F.trim(F.regexp_extract(x, line, 2)).alias("v")))
    return spark.read.option("lineSep", end).text(path).select(lines.alias("lines")).where(F.size("lines") > 0)


def _values(tag: str) -> Column:
    return F.transform(F.filter("lines", lambda x: x["t"] == tag), lambda x: x["v"])


def _text(values: Column) -> Column:
    joined = F.array_join(values, " ")
    return F.when(joined != "", joined)


def read_wos_plain(spark: SparkSession, path: str) -> DataFrame:
    """SRC-09: Web of Science plain text (two-sign tags, continuation by three blanks, ER)."""
    items = "\x01"
    r = _records(spark, path, "\nER", (r"\n   ", items), r"^([A-Z][A-Z0-9]) (.*)$")
    out = {}
    for field, tag in WOS_TAGS.items():
        lines = F.flatten(F.transform(_values(tag), lambda v: F.transform(F.split(v, items), lambda x: F.trim(x))))
        out[field] = lines if field in WOS_LINES else _text(lines)
    return _from_wos(r.where(F.exists("lines", lambda x: x["t"] == "TI")).select(*[c.alias(f) for f, c in out.items()]))


def read_wos_tab(spark: SparkSession, path: str) -> DataFrame:
    """SRC-10: Web of Science tab-delimited export (no quoting)."""
    df = spark.read.option("header", True).option("sep", "\t").option("quote", "").csv(path)
    at = {c.strip().lstrip("﻿"): c for c in df.columns}
    cell = {f: (F.col(f"`{at[t]}`") if t in at else F.lit(None).cast("string")) for f, t in WOS_TAGS.items()}
    cell["authors"], cell["references"] = split_list(cell["authors"], ";"), split_list(cell["references"], ";")
    cell["affiliations"] = F.split(cell["affiliations"], r";\s+(?![^\[]*\])")  # not between the names in brackets
    return _from_wos(df.select(*[c.alias(f) for f, c in cell.items()]))


def _from_wos(df: DataFrame) -> DataFrame:
    place = F.transform("affiliations", lambda a: F.trim(F.regexp_replace(a, r"^\[[^\]]*\]", "")))
    return df.withColumns({"affiliations": place, "keywords": split_list(F.col("keywords"), ";"), "index_keywords": split_list(F.col("index_keywords"), ";")})


def read_pubmed(spark: SparkSession, path: str) -> DataFrame:
    """SRC-11: MEDLINE text (TAG - value, continuation by six blanks, blank line)."""
    r = _records(spark, path, "\n\n", (r"\n {6}\s*", " "), r"^([A-Z]{2,4}) *- (.*)$")
    ids = F.filter(F.concat(_values("LID"), _values("AID")), lambda x: x.contains("[doi]"))
    heading = F.transform(_values("MH"), lambda m: F.regexp_extract(m, r"^\*?([^/]*)", 1))
    return r.where(F.exists("lines", lambda x: x["t"].isin("TI", "PMID"))).select(
        _text(_values("TI")).alias("title"), F.regexp_extract(F.array_join(_values("DP"), " "), r"(\d{4})", 1).alias("year"),
        F.coalesce(_text(_values("JT")), _text(_values("TA"))).alias("source"), _values("AU").alias("authors"), _values("AD").alias("affiliations"),
        _values("OT").alias("keywords"), F.array_distinct(heading).alias("index_keywords"),
        F.regexp_extract(F.get(ids, F.lit(0)), r"^(\S+)", 1).alias("doi"), F.array_join(_values("PT"), "; ").alias("doc_type"))


# ---- API JSON ------------------------------------------------------------------------

def read_works_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """SRC-12, SRC-13: Crossref or OpenAlex JSON: a response with a list, one work, or a
    plain list of works; one JSON document per file, or with ``lines`` per line."""
    crossref, openalex = f"struct<{_inner(CROSSREF)}>", f"struct<{_inner(OPENALEX)}, title: string, type: string>"
    read = lambda schema: spark.read.schema(schema).option("multiLine", not lines).json(path)
    own = ["DOI", "container-title", "publication_year", "authorships"]
    probe = read("message struct<DOI: string, items: array<struct<DOI: string>>>, results array<struct<id: string>>, DOI string, `container-title` array<string>, publication_year int, authorships array<struct<countries: array<string>>>")
    seen = probe.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(["message", "results", *own])]).first()
    if seen["n1"] or seen["n4"] or seen["n5"]:
        docs = read(f"results array<{openalex}>, {OPENALEX}, title string, type string")
        one = F.struct(*[F.col(c) for c in docs.columns if c != "results"])
        works = docs.select(F.explode(F.coalesce("results", F.array(one.cast(openalex)))).alias("w"))
        return _from_openalex(works.select("w.*"))
    if seen["n0"] or seen["n2"] or seen["n3"]:
        docs = read(f"message struct<items: array<{crossref}>, {_inner(CROSSREF)}>, {CROSSREF}")
        names = [c for c in docs.columns if c != "message"]
        one = F.struct(*[F.col(f"`{c}`") for c in names]).cast(crossref)
        sole = F.struct(*[F.col(f"message.`{c}`").alias(c) for c in names]).cast(crossref)
        works = F.when(F.col("message").isNull(), F.array(one)).when(F.col("message.items").isNotNull(), F.col("message.items")).otherwise(F.array(sole))
        return _from_crossref(docs.select(F.explode(works).alias("w")).select("w.*"))
    raise ValueError("neither Crossref nor OpenAlex works in this JSON")


def _inner(ddl: str) -> str:
    """A column list ("name type, ...") as the fields of a struct type ("name: type, ...")."""
    from pyspark.sql import types as T

    return ", ".join(f"`{f.name}`: {_type(f.dataType)}" for f in T.StructType.fromDDL(ddl).fields)


def _type(kind) -> str:
    from pyspark.sql import types as T

    if isinstance(kind, T.ArrayType):
        return f"array<{_type(kind.elementType)}>"
    if isinstance(kind, T.StructType):
        return "struct<" + ", ".join(f"`{f.name}`: {_type(f.dataType)}" for f in kind.fields) + ">"
    return kind.simpleString()


def _full(values: Column) -> Column:
    return F.filter(F.coalesce(values, F.array().cast(STRINGS)), lambda x: x.isNotNull() & (x != ""))


def _from_crossref(w: DataFrame) -> DataFrame:
    c = lambda name: F.col(f"`{name}`")
    joined = lambda sep, *parts: F.concat_ws(sep, *[F.when(p != "", p) for p in parts])
    years = [F.get(F.get(F.col(f"`{d}`.`date-parts`"), F.lit(0)), F.lit(0)) for d in _DATES]
    name = F.transform("author", lambda a: F.coalesce(F.when(a["name"] != "", a["name"]), joined(", ", a["family"], a["given"])))
    places = F.flatten(F.transform("author", lambda a: F.coalesce(F.transform(a["affiliation"], lambda p: p["name"]), F.array().cast(STRINGS))))
    cited = F.transform("reference", lambda r: F.coalesce(F.when(r["DOI"] != "", F.concat(F.lit("DOI "), F.lower(r["DOI"]))), F.when(r["unstructured"] != "", r["unstructured"]),
                                                          joined(", ", r["author"], r["year"], r["journal-title"], r["volume"], r["first-page"])))
    return w.select(F.nullif(F.array_join("title", " "), F.lit("")).alias("title"), F.coalesce(*years).alias("year"), F.get(c("container-title"), F.lit(0)).alias("source"),
                    _full(name).alias("authors"), _full(places).alias("affiliations"), F.array().cast(STRINGS).alias("keywords"), _full(F.col("subject")).alias("index_keywords"),
                    c("is-referenced-by-count").alias("citations"), _full(cited).alias("references"), F.col("DOI").alias("doi"), F.col("type").alias("doc_type"))


def _from_openalex(w: DataFrame) -> DataFrame:
    names = lambda col: _full(F.transform(col, lambda x: x["display_name"]))
    ships = lambda f: F.flatten(F.transform("authorships", lambda s: F.coalesce(f(s), F.array().cast(STRINGS))))
    raw, inst = _full(ships(lambda s: s["raw_affiliation_strings"])), _full(ships(lambda s: F.transform(s["institutions"], lambda i: i["display_name"])))
    return w.select(F.coalesce("title", "display_name").alias("title"), F.col("publication_year").alias("year"), F.col("primary_location.source.display_name").alias("source"),
                    _full(F.transform("authorships", lambda s: s["author"]["display_name"])).alias("authors"), F.when(F.size(raw) > 0, raw).otherwise(inst).alias("affiliations"),
                    F.array_sort(F.array_distinct(_full(ships(lambda s: s["countries"])))).alias("countries"), names("keywords").alias("keywords"),
                    names(F.when(F.size("topics") > 0, F.col("topics")).otherwise(F.col("concepts"))).alias("index_keywords"), F.col("cited_by_count").alias("citations"),
                    _full(F.col("referenced_works")).alias("references"), "doi", F.col("type").alias("doc_type"))


# ---- one shape for all ---------------------------------------------------------------

def normalise_publications(df: DataFrame, country_fn=None) -> DataFrame:
    """SRC-15: authors without dots, lower-case keywords, 4-digit year,
    integer citations, countries given or taken from affiliations, DOI lower
    without resolver prefix; rows need a title or a year."""
    given = lambda c: F.col(c) if c in df.columns else F.lit(None)
    listed = lambda c: F.coalesce(given(c).cast(STRINGS), F.array().cast(STRINGS))
    lower = lambda c: F.transform(listed(c), lambda k: F.lower(k))
    seen = F.array_sort(F.array_distinct(F.array_compact(F.transform(listed("affiliations"), country_fn or country_of))))
    text = lambda c: given(c).cast("string")
    return df.select(
        text("title").alias("title"), year_of(text("year")).alias("year"), text("source").alias("source"),
        F.transform(listed("authors"), lambda a: F.trim(F.replace(a, F.lit("."), F.lit("")))).alias("authors"), listed("affiliations").alias("affiliations"),
        F.when(F.size(listed("countries")) > 0, listed("countries")).otherwise(seen).alias("countries"), lower("keywords").alias("keywords"),
        lower("index_keywords").alias("index_keywords"), text("citations").try_cast("int").alias("citations"), listed("references").alias("refs"),
        normalise_doi(text("doi")).alias("doi"), text("doc_type").alias("doc_type")).where("title is not null or year is not null")


def country_of(aff):
    """FN-01: last comma part, trailing '.' cut, postcode and everything
    before it removed, <= 40 chars, alias map, ALL-CAPS over 3 letters to title case."""
    part = F.regexp_replace(F.trim(F.element_at(F.split(aff, ","), -1)), r"\.$", "")
    part = F.trim(F.regexp_replace(part, r"^.*\d\s*", ""))
    m = F.create_map(*[x for k, v in COUNTRY_ALIASES.items() for x in (F.lit(k), F.lit(v))])
    titled = F.when((part == F.upper(part)) & (F.length(part) > 3) & F.regexp_like(part, F.lit("[A-Z]")),
                    F.initcap(part)).otherwise(part)
    return F.when((part == "") | (F.length(part) > 40), F.lit(None).cast("string")).otherwise(
        F.coalesce(F.element_at(m, F.lower(part)), titled))
