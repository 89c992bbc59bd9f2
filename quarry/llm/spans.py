"""Column expressions for spans in texts: every match of a pattern with its place, as
array<struct<s, e, m>> (code points, end exclusive). JVM-side only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STEP = 64


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def matches(text: Column, pattern: str) -> Column:
    """All leftmost, non-overlapping matches of a Java pattern. Places come from the lengths of
    the pieces between the matches; sums go by blocks of ``STEP``, so a text with many
    matches costs no quadratic copying."""
    def placed(v):
        steps = F.zip_with(F.slice(v["gaps"], F.lit(1), F.size(v["found"])), v["found"], lambda g, m: F.length(g) + F.length(m))
        return let(F.struct(v["found"].alias("found"), steps.alias("steps")), summed)

    def summed(v):
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v["steps"]) - 1) / STEP).cast("int")),
                             lambda b: total(F.slice(v["steps"], b * STEP + 1, F.lit(STEP))))
        return let(F.struct(v["found"].alias("found"), v["steps"].alias("steps"), blocks.alias("blocks")),
                   lambda w: F.transform(w["found"], lambda m, i: span(w, m, i)))

    def span(w, m, i):
        b = F.floor(i / STEP).cast("int")
        end = total(F.slice(w["blocks"], F.lit(1), b)) + total(F.slice(w["steps"], b * STEP + 1, i - b * STEP + 1))
        return F.struct((end - F.length(m)).alias("s"), end.alias("e"), m.alias("m"))

    def total(a):
        return F.aggregate(a, F.lit(0), lambda x, y: x + y)

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(found, lambda m: F.when(F.size(m) > 0, let(F.struct(m.alias("found"), F.split(text, pattern, -1).alias("gaps")), placed)).otherwise(NONE()))


def NONE() -> Column:  # noqa: N802
    return F.array().cast("array<struct<s:int,e:int,m:string>>")


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    def value(d, i):
        x = d.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(x > 9, x - 9).otherwise(x)

    each = F.transform(F.split(F.reverse(number), ""), value)
    return F.aggregate(each, F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))) % 10 == 0


def listed(spans: Column, names: list[str]) -> Column:
    """``kind:start:end`` of sorted (s, k, e, ...) structs, comma-joined."""
    kind = F.array(*map(F.lit, names))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kind, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def of_kind(spans: Column, k: int) -> Column:
    """(s, k, e) structs, which sort by start, kind and end."""
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")))
