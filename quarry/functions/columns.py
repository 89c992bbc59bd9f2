"""Column-expression helpers shared by every operator (all JVM-side built-ins)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)
INTEGRAL_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def q(name: str) -> Column:
    """Column by (possibly odd) name."""
    return F.col(f"`{name}`")


def is_numeric_type(dt) -> bool:
    return isinstance(dt, NUMERIC_TYPES) and not isinstance(dt, T.BooleanType)


def numeric_columns(df: DataFrame) -> list[str]:
    """PRJ-01: numeric columns; booleans are not numeric."""
    return [f.name for f in df.schema.fields if is_numeric_type(f.dataType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def is_missing(c: Column, dtype=None) -> Column:
    """PRJ-02: missing = NULL, or a text value that is blank (whitespace only)."""
    if dtype is not None and not isinstance(dtype, T.StringType):
        return c.isNull()
    return c.isNull() | F.regexp_like(c.cast("string"), F.lit(r"^\s*$"))


def is_missing_col(df: DataFrame, name: str) -> Column:
    return is_missing(q(name), df.schema[name].dataType)


def md5key(seed, *cols) -> Column:
    """Deterministic pseudo-random key, identical in Spark and DuckDB:
    md5(concat_ws('|', seed, key...)). Partition-independent, so splits,
    folds and samples are reproducible and oracle-checkable."""
    parts = [F.lit(str(seed))] + [c.cast("string") if isinstance(c, Column) else q(c).cast("string")
                                  for c in cols]
    return F.md5(F.concat_ws("|", *parts))


def uniform(seed, *cols) -> Column:
    """u in [0, 1) from the first 13 hex digits of md5key."""
    h = F.substring(md5key(seed, *cols), 1, 13)
    return F.conv(h, 16, 10).cast("bigint").cast("double") / float(16 ** 13)


def bround_half_even(c: Column, digits: int = 0) -> Column:
    """Python round() is half-even; Spark bround is the same rule."""
    return F.bround(c, digits)


def safe_div(a: Column, b: Column) -> Column:
    return F.try_divide(a, F.nullif(b, F.lit(0)))
