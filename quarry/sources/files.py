"""File readers (SRC-01..03) and sinks (SNK-01..05); publication exports are in
publications.py.

Readers decide small things from a bounded head of the file (delimiter,
encoding, export format) and then hand the whole file to Spark's own
CSV/JSON/text sources — every row is parsed by executors.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import DECIMAL_COMMA_RE
from ..session import ensure_checkpoint_dir

DELIMITERS = [",", ";", "\t", "|"]
HEAD_LINES = 200


def head_lines(spark: SparkSession, path: str, n: int = HEAD_LINES, keep_returns: bool = False) -> list[str]:
    """The first lines of a file (or of the first files of a folder)."""
    reader = spark.read.option("lineSep", "\n") if keep_returns else spark.read
    return [r[0] for r in reader.text(path).limit(n).collect()]


def _count_outside_quotes(line: str, ch: str) -> int:
    n, quoted = 0, False
    for c in line:
        if c == '"':
            quoted = not quoted
        elif c == ch and not quoted:
            n += 1
    return n


def sniff_delimiter(lines: list[str]) -> str:
    """The delimiter that appears the same non-zero number of times (outside
    quotes) on the most head lines; one column => ','."""
    best, score = ",", 0
    for d in DELIMITERS:
        counts = [_count_outside_quotes(x, d) for x in lines if x.strip()]
        if not counts or counts[0] == 0:
            continue
        consistent = sum(1 for c in counts if c == counts[0])
        if consistent > score:
            best, score = d, consistent
    return best


def scan_lines(spark: SparkSession, path: str, sep: str) -> dict:
    """One pass over all lines: whether they are UTF-8, whether a quoted cell runs over a
    line break (a line with an odd number of quotes), and the rows whose cells do not match
    the header's."""
    line = F.col("value")
    odd = F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))
    r = spark.read.text(path).agg(F.count_if(~F.is_valid_utf8(line.cast("binary"))).alias("bad"), F.count_if(odd % 2 == 1).alias("open")).first()
    return {"encoding": "windows-1252" if r["bad"] else "UTF-8", "broken": bool(r["open"])}


def fix_decimal_commas(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """SRC-03: a text column whose non-null values all look like "22,5" /
    "1.234,5" becomes double (one aggregate decides for every column)."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not text:
        return df, []
    r = df.agg(*[F.coalesce(F.bool_and(F.regexp_like(F.trim(F.col(f"`{c}`")), F.lit(DECIMAL_COMMA_RE))),
                            F.lit(False)).alias(f"c{i}") for i, c in enumerate(text)]).first()
    conv = [c for i, c in enumerate(text) if r[f"c{i}"]]
    out = df.select(*[(F.replace(F.replace(F.trim(F.col(f"`{c}`")), F.lit("."), F.lit("")), F.lit(","), F.lit("."))
                       .try_cast("double").alias(c) if c in conv else F.col(f"`{c}`")) for c in df.columns])
    return out, conv


def read_delimited(spark: SparkSession, path: str, sep: str | None = None) -> tuple[DataFrame, list[str]]:
    """SRC-01: CSV/TSV with sniffed delimiter and encoding; returns notes of
    what was decided. Non-comma files get the decimal-comma pass (SRC-03) and
    NaN/inf cleanup (SRC-06)."""
    from .tables import inf_to_null

    sep, given = sep or sniff_delimiter(head_lines(spark, path)), sep
    seen = scan_lines(spark, path, sep)
    # a file with line breaks inside cells cannot be split; all others are
    reader = (spark.read.option("header", True).option("sep", sep).option("encoding", seen["encoding"])
              .option("multiLine", seen["broken"]).option("quote", '"').option("escape", '"'))
    df = reader.option("inferSchema", True).csv(path)
    wide = reader.schema(T.StructType([*[T.StructField(c, T.StringType()) for c in df.columns], T.StructField("_misfit", T.StringType())]))
    misfits = wide.option("columnNameOfCorruptRecord", "_misfit").option("enforceSchema", True).csv(path)
    n_misfits = misfits.cache().where(F.col("_misfit").isNotNull()).count()
    misfits.unpersist()
    told = {f"read as {seen['encoding']}: not all of it is UTF-8": seen["encoding"] != "UTF-8",
            f"delimiter: {'tab' if sep == chr(9) else sep}": given is None and sep != ",",
            f"{n_misfits} rows have more or fewer cells than the header": n_misfits > 0}
    numbers: list[str] = []
    if sep != ",":
        df, numbers = fix_decimal_commas(df)
    return inf_to_null(df), [note for note, holds in told.items() if holds] + [f"{c}: decimal commas read as numbers" for c in numbers]


def read_json_records(spark: SparkSession, path: str) -> DataFrame:
    """SRC-02: a JSON array of row objects, or one object {column: [values]}."""
    df = spark.read.option("multiLine", True).json(path)
    fields = df.schema.fields
    if fields and all(isinstance(f.dataType, T.ArrayType) for f in fields) and df.count() == 1:
        z = F.arrays_zip(*[F.col(f"`{f.name}`").alias(f.name) for f in fields])
        return df.select(F.inline(z))
    return df


# ---- sinks ---------------------------------------------------------------------------

def scratch_path(spark: SparkSession, name: str) -> str:
    """A folder under the shared checkpoint directory (cluster-visible)."""
    return os.path.join(ensure_checkpoint_dir(spark), "quarry-out", name)


def write_prepared(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """SNK-01/02/03: write a prepared / predictions / assignments table,
    partitioned by the split tag when present."""
    w = df.write.mode("overwrite")
    if "__split__" in df.columns:
        w = w.partitionBy("__split__")
    (w.option("header", True).csv(path) if fmt == "csv" else w.parquet(path))


def report_table(df: DataFrame) -> DataFrame:
    """SNK-05: lists joined by '; ' so a table can be written to any format."""
    return df.select(*[(F.array_join(F.col(f"`{f.name}`"), "; ").alias(f.name)
                        if isinstance(f.dataType, T.ArrayType) else F.col(f"`{f.name}`")) for f in df.schema.fields])


def save_state(spark: SparkSession, state: dict, path: str) -> None:
    """SNK-04: fitted state as JSON with the Spark version; written through
    Spark so the path may be any cluster file system."""
    doc = json.dumps({"spark_version": spark.version, "state": state}, default=str)
    spark.createDataFrame([(doc,)], "doc string").coalesce(1).write.mode("overwrite").text(path)


def load_state(spark: SparkSession, path: str) -> dict:
    doc = json.loads(spark.read.text(path).first()[0])
    if doc.get("spark_version") != spark.version:
        raise ValueError(f"state was saved with Spark {doc.get('spark_version')}, this is {spark.version}")
    return doc["state"]
