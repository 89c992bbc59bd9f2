"""Registry of named queries: a Spark callable (spark, sf_dir) -> DataFrame and,
where SQL can say it, the DuckDB twin used as the correctness oracle.

Floating columns are rounded in both engines (``rounded`` / ``sql_rounded``)
so summation-order noise does not change the value hash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


SIG = 10  # significant digits kept in compared floating columns


def sig_round(c, sig: int = SIG):
    """Round to ``sig`` significant digits: scale by an exact power of ten,
    round, scale back (bitwise identical in Spark and DuckDB)."""
    e = F.floor(F.log10(F.abs(c)))
    s = F.pow(F.lit(10.0), F.abs(e))
    d = sig - 1
    return (F.when(c.isNull() | F.isnan(c), c).when(F.abs(c) < 1e-9, F.lit(0.0))
            .when(e >= 0, F.round(c / s, d) * s)
            .otherwise(F.round(c * s, d) / s))


def rounded(df: DataFrame, sig: int = SIG) -> DataFrame:
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            out.append(sig_round(c.cast("double"), sig).alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def sql_sig(c: str, sig: int = SIG) -> str:
    d = sig - 1
    x = f"cast({c} as double)"
    e = f"floor(log10(abs({x})))"
    s = f"pow(10.0, abs({e}))"
    return (f"(case when {x} is null or isnan({x}) then {x} when abs({x}) < 1e-9 then 0.0 "
            f"when {e} >= 0 then round({x} / {s}, {d}) * {s} else round({x} * {s}, {d}) / {s} end)")


def sql_rounded(inner: str, cols: list[str], sig: int = SIG) -> str:
    """Wrap DuckDB SQL so the listed double columns are rounded like ``rounded``."""
    if not cols:
        return inner
    rep = ", ".join(f"{sql_sig(c, sig)} as {c}" for c in cols)
    return f"select * replace ({rep}) from ({inner}) as __t"
