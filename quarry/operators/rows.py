"""Row-level projections, guards and previews (PRJ-06..14, WIN-04, SET-01..05)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import is_missing, is_numeric_type, q

PAGE_MAX = 200
MIN_ROWS = 5
MAX_CHOICES = 50


def guard_target(df: DataFrame, target: str, task: str) -> tuple[DataFrame, list[str]]:
    """PRJ-06: drop rows without a target; regression needs a numeric target,
    classification >= 2 classes; classes with a single row are noted."""
    d = df.where(~is_missing(q(target), df.schema[target].dataType))
    notes = []
    if task == "regression":
        if not is_numeric_type(df.schema[target].dataType):
            raise ValueError(f"'{target}' must be numeric for regression.")
        return d, notes
    sizes = d.groupBy(q(target).cast("string").alias("c")).count()
    seen = sizes.agg(F.count("*").alias("classes"), F.count_if(F.col("count") == 1).alias("single")).first()
    if seen["classes"] < 2:
        raise ValueError(f"'{target}' needs at least 2 classes.")
    if seen["single"]:
        some = [r["c"] for r in sizes.where("count = 1").orderBy("c").limit(10).collect()]
        notes.append(f"{seen['single']} classes with one row: {', '.join(some)}" + (" ..." if seen["single"] > 10 else ""))
    return d, notes


def prepare_rows(df: DataFrame, target: str, columns: list[str], task: str, group: str | None = None) -> DataFrame:
    """PRJ-07: target guard, rows without a group dropped, rows missing a
    listed column dropped, only the features (target and group excluded) kept."""
    d, _ = guard_target(df, target, task)
    if group:
        d = d.where(q(group).isNotNull())
    feats = [c for c in columns if c not in (target, group)]
    d = d.dropna(subset=feats)
    return d.select(*[q(c) for c in feats], q(target), *([q(group)] if group else []))


def page(df: DataFrame, order: list[str], offset: int = 0, limit: int = 50) -> DataFrame:
    """PRJ-08: one page of rows in a total order (limit <= 200)."""
    limit = max(1, min(int(limit), PAGE_MAX))
    return df.orderBy(*[q(c) for c in order]).offset(max(0, int(offset))).limit(limit)


def test_rows(rows: DataFrame, preds: DataFrame, key: str, mistakes_only: bool = False, offset: int = 0,
              limit: int = 50) -> DataFrame:
    """PRJ-09 / JN-06: test rows joined to predictions: actual, prediction,
    correct, confidence (largest class probability)."""
    j = rows.join(preds, key)
    j = j.withColumn("correct", F.col("label") == F.col("prediction"))
    if "probability" in j.columns:
        from pyspark.ml.functions import vector_to_array
        j = j.withColumn("confidence", F.array_max(vector_to_array("probability")))
    if mistakes_only:
        j = j.where(~F.col("correct"))
    return page(j, [key], offset, limit)


def search_rows(df: DataFrame, text: str) -> DataFrame:
    """PRJ-10: rows where any column contains ``text`` (case-insensitive)."""
    needle = F.lit(text.lower())
    vals = F.array(*[F.coalesce(q(c).cast("string"), F.lit("")) for c in df.columns])
    return df.where(F.exists(vals, lambda v: F.contains(F.lower(v), needle)))


def period_filter(df: DataFrame, a: int, b: int, col: str = "year") -> DataFrame:
    """PRJ-14: a <= year < b."""
    return df.where((q(col) >= a) & (q(col) < b))


def keep_first(df: DataFrame, key: str, subset: list[str] | None = None) -> DataFrame:
    """WIN-04 / CLN-09: first occurrence (smallest key) of each duplicate
    group. Rows of a group are identical on ``subset`` (default: all other
    columns), so the group's values plus min(key) are the answer — a plain
    aggregate with map-side combine, even for a group holding a third of the rows."""
    cols = subset or [c for c in df.columns if c != key]
    rest = [c for c in df.columns if c not in cols and c != key]
    if rest:
        first = df.groupBy(*[q(c) for c in cols]).agg(F.min(q(key)).alias(key))
        return first.join(df.select(q(key), *[q(c) for c in rest]), key)
    return df.groupBy(*[q(c) for c in cols]).agg(F.min(q(key)).alias(key))


def input_schema(train: DataFrame, columns: list[str]) -> DataFrame:
    """PRJ-13: per column kind, choices (<= 50, sorted), integer flag,
    training min/max, whether missing values were seen."""
    rows = []
    num = [c for c in columns if is_numeric_type(train.schema[c].dataType)]
    aggs = []
    for i, c in enumerate(columns):
        aggs.append(F.count_if(q(c).isNull()).alias(f"n{i}"))
        if c in num:
            aggs += [F.min(q(c).cast("double")).alias(f"mn{i}"), F.max(q(c).cast("double")).alias(f"mx{i}"),
                     F.coalesce(F.bool_and(q(c).cast("double") % 1 == 0), F.lit(False)).alias(f"w{i}")]
    r = train.agg(*aggs).first()
    for i, c in enumerate(columns):
        if c in num:
            rows.append((c, "number", None, bool(r[f"w{i}"]), r[f"mn{i}"], r[f"mx{i}"], r[f"n{i}"] > 0))
        else:
            ch = [x[0] for x in train.where(q(c).isNotNull()).select(q(c).cast("string")).distinct()
                  .orderBy(1).limit(MAX_CHOICES + 1).collect()]
            kind = "category" if len(ch) <= MAX_CHOICES else "text"
            rows.append((c, kind, ch if kind == "category" else None, False, None, None, r[f"n{i}"] > 0))
    return train.sparkSession.createDataFrame(
        rows, "name string, kind string, choices array<string>, integer boolean, min double, max double, "
              "missing_ok boolean")


def check_rows(df: DataFrame, schema: DataFrame) -> DataFrame:
    """PRJ-12: per row the list of problems against a saved input schema:
    required value missing, number not finite, category not learned; plus
    notes for numbers outside the training range. Every row is checked."""
    errs, notes = [], []
    for f in schema.collect():  # one row per input column
        c = q(f["name"])
        blank = c.isNull() | (F.trim(c.cast("string")) == "")
        if not f["missing_ok"]:
            errs.append(F.when(blank, F.lit(f"{f['name']} is required")))
        if f["kind"] == "number":
            x = c.cast("string").try_cast("double")
            errs.append(F.when(~blank & (x.isNull() | F.isnan(x) | x.isin(float("inf"), float("-inf"))),
                               F.lit(f"{f['name']} must be a number")))
            if f["min"] is not None:
                notes.append(F.when(~blank & ((x < f["min"]) | (x > f["max"])),
                                    F.lit(f"{f['name']} outside the training range")))
        elif f["kind"] == "category":
            ch = F.array(*[F.lit(v) for v in f["choices"]])
            errs.append(F.when(~blank & ~F.array_contains(ch, c.cast("string")),
                               F.lit(f"{f['name']} is not a learned category")))
    empty = F.array().cast("array<string>")
    return df.withColumn("errors", F.array_compact(F.array(*errs)) if errs else empty) \
        .withColumn("notes", F.array_compact(F.array(*notes)) if notes else empty)


def union_split(train: DataFrame, test: DataFrame) -> DataFrame:
    """SET-01: train and test parts in one table with a split tag."""
    return (train.withColumn("__split__", F.lit("train"))
            .unionByName(test.withColumn("__split__", F.lit("test")), allowMissingColumns=True))
