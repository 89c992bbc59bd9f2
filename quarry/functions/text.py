"""String functions and the fixed patterns/word lists the operators rely on.

All patterns are written so Java regex (Spark) and RE2 (DuckDB) read them the
same way: no look-around, anchors instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values (must equal the reference's rules) ----------------------
# e-mail: something@something.tld, no spaces
EMAIL_RE = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
# phone characters: optional +, digits, spaces, brackets, dots, dashes
PHONE_RE = r"^\+?[\d\s().-]+$"
# a 4-digit year not inside a longer number, or a leading nn/nn/yy date
YEAR_RE = r"(^|\D)\d{4}(\D|$)|^\s*\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2}(\D|$)"
# decimal comma ("22,5", "1.234,5") and thousands comma ("1,200", "1,200.5")
DECIMAL_COMMA_RE = r"^[+-]?(\d{1,3}(\.\d{3})+|\d+),\d+$"
THOUSANDS_COMMA_RE = r"^[+-]?\d{1,3}(,\d{3})+(\.\d+)?$"
# DOIs inside free reference text
DOI_RE = r"10\.\d{4,9}/[^\s;,]+"
# title / text words: a letter then letters or hyphens, 3+ characters
WORD_RE = r"[a-z][a-z-]{2,}"
# tokens for TF-IDF word analyzer: two or more word characters
TOKEN_RE = r"\w\w+"
# tokens treated as missing by nullify()
MISSING_TOKENS = ["", "na", "n/a", "nan", "null", "none", "-", "--", "?", "missing", "unknown"]

# date-looking text (re-aimed from a mixed-format parser): ISO date/time,
# day/month/year with / . -, "5 March 2020", "March 5, 2020"
DATE_RE = (r"^\s*(\d{4}[-/.]\d{1,2}[-/.]\d{1,2}([T ]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?)?(Z|[+-]\d{2}:?\d{2})?"
           r"|\d{1,2}[-/.]\d{1,2}[-/.]\d{2}(\d{2})?( \d{1,2}:\d{2}(:\d{2})?)?"
           r"|\d{1,2} [A-Za-z]{3,9},? \d{4}|[A-Za-z]{3,9} \d{1,2},? \d{4})\s*$")

def word_count(c: Column) -> Column:
    """FN-07: whitespace-separated words (0 for blank)."""
    t = F.trim(c)
    return F.when(c.isNull(), F.lit(None)).when(t == "", F.lit(0)).otherwise(F.size(F.split(t, r"\s+")))


def split_list(c: Column, sep: str = ";") -> Column:
    """FN-04: split on ``sep``, trim the parts, drop empty parts."""
    parts = F.transform(F.split(c, sep), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def ref_key(c: Column) -> Column:
    """FN-03: lower case, runs of spaces collapsed, trailing . ; , and spaces cut."""
    x = F.regexp_replace(F.lower(F.trim(c)), r"\s+", " ")
    return F.regexp_replace(x, r"[.;, ]+$", "")


def normalise_doi(c: Column) -> Column:
    """FN-09: lower, trimmed, no resolver prefix (https://doi.org/, doi:)."""
    x = F.lower(F.trim(c))
    return F.regexp_replace(x, r"^(https?://(dx\.)?doi\.org/|doi:\s*)", "")


def extract_dois(c: Column) -> Column:
    """FN-05: every DOI in a text, lower case, trailing '.' cut."""
    found = F.regexp_extract_all(F.lower(c), F.lit(f"({DOI_RE})"), 1)
    return F.transform(found, lambda x: F.regexp_replace(x, r"\.+$", ""))


def year_of(c: Column) -> Column:
    """FN-08: first 4-digit run as int (null if none)."""
    return F.nullif(F.regexp_extract(c.cast("string"), r"(\d{4})", 1), F.lit("")).try_cast("int")


def is_email(c: Column) -> Column:
    return F.regexp_like(F.trim(c), F.lit(EMAIL_RE))


def is_phone(c: Column) -> Column:
    """FN-10: phone characters only, 7-15 digits, some formatting character."""
    t = F.trim(c)
    return (F.regexp_like(t, F.lit(PHONE_RE)) & F.length(F.regexp_replace(t, r"\D", "")).between(7, 15)
            & F.regexp_like(t, F.lit(r"[+ ()\-.]")))
