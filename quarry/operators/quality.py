"""Data-quality checks (DQ-01..14) as aggregates that return findings.

``column_facts`` is the one shared pass: a wide aggregate per batch of
columns (counts, blanks, min/max, whole-number flag, value-pattern shares)
plus exact distinct counts over the unpivoted (column, value) form and the
median word count of text columns. Every check below is a projection of that
small facts table (one row per column), so a full quality report costs a
handful of Spark jobs regardless of the number of checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import is_numeric_type, q
from ..functions.text import DATE_RE, EMAIL_RE, PHONE_RE, YEAR_RE, word_count
from .profile import _batches, distinct_counts
from .ranks import exact_quantiles, unpivot

# fixed thresholds of the checks (must equal the reference's)
IQR_MULTIPLIER = 1.5
CATEGORICAL_THRESHOLD = 0.5
MAX_CATEGORICAL_UNIQUE = 50
ID_RATIO_THRESHOLD = 0.95
ID_SPAN_MAX = 2.0
CARDINALITY_THRESHOLD = 0.5
CARDINALITY_MIN_UNIQUE = 20
FREETEXT_MIN_UNIQUE = 0.5
FREETEXT_MIN_WORDS = 3
PERSONAL_MIN_SHARE = 0.5
DATETIME_SHARE = 0.8
NUMERIC_TEXT_SHARE = 0.8
BOOLEAN_VALUE_SETS = [("no", "yes"), ("false", "true"), ("f", "t"), ("n", "y"), ("0", "1")]


def _kind(dt) -> str:
    if isinstance(dt, T.BooleanType):
        return "boolean"
    if is_numeric_type(dt):
        return "numeric"
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    return "text"


def column_facts(df: DataFrame) -> DataFrame:
    """One row per column: column, kind, rows, nulls, blanks, non_null,
    n_distinct, min, max, all_whole, negatives, zeros, numeric_text, whitespace,
    emails, phones, date_like, year_like, median_words, bool_pair."""
    spark = df.sparkSession
    fields = df.schema.fields
    parts = []
    for batch in _batches(fields, 25):
        aggs = [F.count(F.lit(1)).alias("rows")]
        rows = []
        for i, f in enumerate(batch):
            c, k = q(f.name), _kind(f.dataType)
            s = c.cast("string")
            t = _stripped(s)
            nonblank = c.isNotNull() & ~F.regexp_like(s, F.lit(r"^\s*$"))
            num = c.cast("double") if k == "numeric" else F.lit(None).cast("double")
            text = k == "text"
            zero = F.lit(0).cast("long")
            cnt = {
                "nl": F.count_if(c.isNull()),
                "bl": F.count_if(c.isNotNull() & F.regexp_like(s, F.lit(r"^\s*$"))) if text else zero,
                "ng": F.count_if(num < 0), "zr": F.count_if(num == 0),
                "nt": (F.count_if(c.isNotNull() & F.replace(t, F.lit(","), F.lit("")).try_cast("double").isNotNull())
                       if text else zero),
                "ws": F.count_if(c.isNotNull() & (s != t)) if text else zero,
                "em": F.count_if(nonblank & F.regexp_like(t, F.lit(EMAIL_RE))) if text else zero,
                "ph": (F.count_if(nonblank & F.regexp_like(t, F.lit(PHONE_RE))
                                  & F.length(F.regexp_replace(t, r"\D", "")).between(7, 15)
                                  & F.regexp_like(t, F.lit(r"[+ ()\-.]"))) if text else zero),
                "dt": F.count_if(c.isNotNull() & F.regexp_like(t, F.lit(DATE_RE))) if text else zero,
                "yr": F.count_if(c.isNotNull() & F.regexp_like(s, F.lit(YEAR_RE))) if text else zero,
                "nb": F.count_if(nonblank) if text else zero,
            }
            aggs += [v.cast("long").alias(f"{key}{i}") for key, v in cnt.items()]
            aggs += [F.min(num).alias(f"mn{i}"), F.max(num).alias(f"mx{i}"),
                     F.coalesce(F.bool_and(num % 1 == 0), F.lit(False)).alias(f"wh{i}")]
            rows.append((i, f.name, k))
        wide = df.agg(*aggs)
        keys = ["nl", "bl", "mn", "mx", "wh", "ng", "zr", "nt", "ws", "em", "ph", "dt", "yr", "nb"]
        st = ", ".join(f"'{n}', '{k}', " + ", ".join(f"{key}{i}" for key in keys) for i, n, k in rows)
        parts.append(wide.selectExpr("rows", f"stack({len(rows)}, {st}) as (column, kind, "
                                             "nulls, blanks, min, max, all_whole, negatives, zeros, numeric_text, "
                                             "whitespace, emails, phones, date_like, year_like, nonblank)"))
    facts = parts[0]
    for p in parts[1:]:
        facts = facts.unionByName(p)
    names = [f.name for f in fields]
    dist = distinct_counts(df, names)
    text_cols = [f.name for f in fields if _kind(f.dataType) == "text"]
    boolean = _bool_pairs(df, names)
    out = facts.join(dist, "column", "left").join(boolean, "column", "left")
    if text_cols:
        words = (unpivot(df, text_cols, value_type="string")
                 .where(F.col("value").isNotNull())
                 .select("column", word_count(F.col("value")).cast("double").alias("value")))
        med = exact_quantiles(words, [0.5], by=["column"]).select("column", F.col("q_0").alias("median_words"))
        out = out.join(med, "column", "left")
    else:
        out = out.withColumn("median_words", F.lit(None).cast("double"))
    return out.select(
        "column", "kind", F.col("rows").cast("long").alias("rows"), F.col("nulls").cast("long").alias("nulls"),
        F.col("blanks").cast("long").alias("blanks"), (F.col("rows") - F.col("nulls")).cast("long").alias("non_null"),
        F.coalesce("n_distinct", F.lit(0)).cast("long").alias("n_distinct"), "min", "max", "all_whole",
        F.col("negatives").cast("long").alias("negatives"), F.col("zeros").cast("long").alias("zeros"),
        F.col("numeric_text").cast("long").alias("numeric_text"), F.col("whitespace").cast("long").alias("whitespace"),
        F.col("emails").cast("long").alias("emails"), F.col("phones").cast("long").alias("phones"),
        F.col("date_like").cast("long").alias("date_like"), F.col("year_like").cast("long").alias("year_like"),
        F.col("nonblank").cast("long").alias("nonblank"), "median_words",
        F.coalesce("is_bool_pair", F.lit(False)).alias("is_bool_pair"))


def _stripped(c):
    """Text without white space of any kind at its ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _bool_pairs(df: DataFrame, names: list[str]) -> DataFrame:
    """column -> exactly two distinct values forming a yes/no-like pair."""
    long = unpivot(df, names, value_type="string").where(F.col("value").isNotNull())
    d = long.select("column", F.lower(_stripped(F.col("value"))).alias("v")).distinct()
    # with two values the smallest and the largest are all of them
    g = d.groupBy("column").agg(F.count(F.lit(1)).alias("k"), F.min("v").alias("a"), F.max("v").alias("b"))
    pairs = F.array(*[F.struct(F.lit(a), F.lit(b)) for a, b in BOOLEAN_VALUE_SETS])
    # raw distinct count must be 2 as well: checked by the caller with n_distinct
    return g.select("column", ((F.col("k") == 2) & F.exists(pairs, lambda p: (p["col1"] == F.col("a")) & (p["col2"] == F.col("b")))).alias("is_bool_pair"))


def _looks_like_dates(f=None):
    nn = F.col("non_null")
    return ((F.col("kind") == "datetime") |
            ((F.col("kind") == "text") & (nn > 0) & (F.col("date_like") >= DATETIME_SHARE * nn)
             & (F.col("year_like") >= DATETIME_SHARE * nn)))


def _text_kind():
    ratio = F.col("n_distinct") / F.greatest(F.col("non_null"), F.lit(1))
    return F.when((F.col("non_null") > 0) & (ratio >= FREETEXT_MIN_UNIQUE)
                  & (F.col("median_words") >= FREETEXT_MIN_WORDS), "free_text").otherwise("string")


def detect_missing(facts: DataFrame) -> DataFrame:
    """DQ-01 per column: missing (null + blank), percent, null and blank counts."""
    m = F.col("nulls") + F.col("blanks")
    return facts.where(m > 0).select(
        "column", m.alias("missing_count"), F.bround(m * 100.0 / F.col("rows"), 2).alias("missing_percent"),
        F.col("nulls").alias("null_count"), F.col("blanks").alias("empty_string_count"))


def rows_with_missing(df: DataFrame) -> DataFrame:
    """DQ-01 summary: total rows, total missing cells, rows with >= 1 missing."""
    from ..functions.columns import is_missing
    flags = [is_missing(q(f.name), f.dataType).cast("int") for f in df.schema.fields]
    cells = F.aggregate(F.array(*flags), F.lit(0), lambda a, b: a + b)
    return df.select(cells.alias("k")).agg(
        F.count(F.lit(1)).alias("total_rows"), F.sum("k").cast("long").alias("total_missing_cells"),
        F.count_if(F.col("k") > 0).alias("rows_with_missing"))


def detect_duplicates(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """DQ-02: duplicates beyond the first, rows involved, unique rows, percent."""
    cols = [q(c) for c in (subset or df.columns)]
    g = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    s = g.agg(F.sum("n").alias("total_rows"), F.sum(F.col("n") - 1).alias("duplicate_rows"),
              F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("rows_involved"))
    return s.select(F.col("total_rows").cast("long"), F.col("duplicate_rows").cast("long"),
                    F.bround(F.col("duplicate_rows") * 100.0 / F.col("total_rows"), 2).alias("duplicate_percent"),
                    F.col("rows_involved").cast("long"),
                    (F.col("total_rows") - F.col("duplicate_rows")).cast("long").alias("unique_rows"))


def duplicate_groups(df: DataFrame, key: str, limit: int = 20) -> DataFrame:
    """DQ-03: groups of identical rows (all value columns equal): copies, the
    sorted row keys, ordered by first appearance (smallest key). Row keys are
    collected per group only for the ``limit`` groups shown; the group count
    itself is a plain aggregate."""
    vals = [q(c) for c in df.columns if c != key]
    g = (df.groupBy(*vals).agg(F.count(F.lit(1)).alias("copies"), F.min(q(key)).alias("first_key"))
         .where(F.col("copies") > 1))
    shown = g.orderBy("first_key").limit(limit)
    keys = df.join(shown.select(*[c for c in df.columns if c != key], "first_key", "copies"),
                   on=[c for c in df.columns if c != key], how="inner")
    return (keys.groupBy("first_key", "copies")
            .agg(F.array_join(F.array_sort(F.collect_list(q(key).cast("long"))).cast("array<string>"), ",")
                 .alias("row_keys"))
            .select(F.col("first_key").cast("long").alias("first_key"), F.col("copies").cast("long"), "row_keys"))


def detect_outliers(df: DataFrame, k: float = IQR_MULTIPLIER) -> DataFrame:
    """DQ-04: Tukey fences per numeric column (exact quartiles); iqr = 0 skipped;
    count, percent of all rows, bounds, min, max. Two passes: quantiles, then
    one aggregate of conditional counts."""
    from .profile import quantiles_long
    num = [f.name for f in df.schema.fields if is_numeric_type(f.dataType)]
    if not num:
        return df.sparkSession.createDataFrame([], "column string, outlier_count long, outlier_percent double, "
                                                   "lower_bound double, upper_bound double, min_value double, "
                                                   "max_value double")
    qs = quantiles_long(df, num, [0.25, 0.75]).collect()  # one row per numeric column
    bounds = {}
    for r in qs:
        if r["q_0"] is None:
            continue
        iqr = r["q_1"] - r["q_0"]
        if iqr == 0:
            continue
        bounds[r["column"]] = (r["q_0"] - k * iqr, r["q_1"] + k * iqr)
    if not bounds:
        return df.sparkSession.createDataFrame([], "column string, outlier_count long, outlier_percent double, "
                                                   "lower_bound double, upper_bound double, min_value double, "
                                                   "max_value double")
    aggs = [F.count(F.lit(1)).alias("rows")]
    names = list(bounds)
    for i, c in enumerate(names):
        lo, hi = bounds[c]
        x = q(c).cast("double")
        aggs += [F.count_if((x < lo) | (x > hi)).alias(f"o{i}"), F.min(x).alias(f"mn{i}"), F.max(x).alias(f"mx{i}")]
    wide = df.agg(*aggs)
    st = ", ".join(f"'{c}', o{i}, {bounds[c][0]!r}D, {bounds[c][1]!r}D, mn{i}, mx{i}" for i, c in enumerate(names))
    long = wide.selectExpr("rows", f"stack({len(names)}, {st}) as (column, n, lower_bound, upper_bound, "
                                   "min_value, max_value)")
    return long.where(F.col("n") > 0).select(
        "column", F.col("n").cast("long").alias("outlier_count"),
        F.bround(F.col("n") * 100.0 / F.col("rows"), 2).alias("outlier_percent"),
        F.bround("lower_bound", 2).alias("lower_bound"), F.bround("upper_bound", 2).alias("upper_bound"),
        "min_value", "max_value")


def detect_constant(df: DataFrame, facts: DataFrame) -> DataFrame:
    """DQ-05: distinct 0 (all missing) or 1 (the value, smallest if text)."""
    c = facts.where(F.col("n_distinct") <= 1).select("column", "n_distinct")
    names = [r["column"] for r in c.collect()]  # at most one row per column
    if not names:
        return df.sparkSession.createDataFrame([], "column string, constant_value string, all_missing boolean")
    aggs = [F.min(q(n).cast("string")).alias(f"v{i}") for i, n in enumerate(names)]
    st = ", ".join(f"'{n}', v{i}" for i, n in enumerate(names))
    return df.agg(*aggs).selectExpr(f"stack({len(names)}, {st}) as (column, constant_value)").select(
        "column", "constant_value", F.col("constant_value").isNull().alias("all_missing"))


def detect_column_types(facts: DataFrame, categorical_threshold: float = CATEGORICAL_THRESHOLD,
                        max_categorical_unique: int = MAX_CATEGORICAL_UNIQUE) -> DataFrame:
    """DQ-06 + DQ-07: boolean -> numeric -> datetime -> categorical -> text,
    with text_kind for text columns."""
    ratio = F.bround(F.col("n_distinct") / F.greatest(F.col("rows"), F.lit(1)), 4)
    is_bool = (F.col("n_distinct") == 2) & F.col("is_bool_pair")
    t = (F.when(is_bool, "boolean").when(F.col("kind") == "numeric", "numeric")
         .when(_looks_like_dates(), "datetime")
         .when((F.col("n_distinct") <= max_categorical_unique) & (ratio <= categorical_threshold), "categorical")
         .otherwise("text"))
    return facts.select("column", t.alias("detected_type"), F.col("n_distinct").alias("distinct_values"),
                        ratio.alias("unique_ratio")).join(
        facts.select("column", _text_kind().alias("tk")), "column").select(
        "column", "detected_type", "distinct_values", "unique_ratio",
        F.when(F.col("detected_type") == "text", F.col("tk")).alias("text_kind"))


def detect_ids(facts: DataFrame, threshold: float = ID_RATIO_THRESHOLD) -> DataFrame:
    """DQ-08: distinct/rows >= 0.95 and (whole numbers spread about one per row,
    or text that is neither free text nor dates)."""
    ratio = F.col("n_distinct") / F.col("rows")
    num_id = F.col("all_whole") & (F.col("max") - F.col("min") + 1 <= ID_SPAN_MAX * F.col("n_distinct"))
    txt_id = (_text_kind() != "free_text") & ~_looks_like_dates()
    is_id = F.when(F.col("kind") == "numeric", num_id).otherwise(txt_id)
    return facts.where((F.col("non_null") > 0) & (F.col("rows") > 0) & (ratio >= threshold) & is_id).select(
        "column", F.col("n_distinct").alias("distinct_values"), F.bround(ratio, 4).alias("unique_ratio"),
        (F.col("n_distinct") == F.col("rows")).alias("is_fully_unique"))


def detect_high_cardinality(facts: DataFrame, threshold: float = CARDINALITY_THRESHOLD,
                            min_unique: int = CARDINALITY_MIN_UNIQUE) -> DataFrame:
    """DQ-09: non-numeric, distinct >= 20, distinct/rows >= 0.5, not dates."""
    ratio = F.col("n_distinct") / F.col("rows")
    return facts.where((F.col("kind") != "numeric") & (F.col("non_null") > 0) & (F.col("n_distinct") >= min_unique)
                       & (ratio >= threshold) & ~_looks_like_dates()).select(
        "column", F.col("n_distinct").alias("distinct_values"), F.bround(ratio, 4).alias("unique_ratio"))


def detect_value_issues(facts: DataFrame) -> DataFrame:
    """DQ-10: negatives / zeros (numeric); numeric-stored-as-text share >= 0.8
    and leading/trailing whitespace (text). Booleans skipped."""
    share = F.col("numeric_text") / F.col("non_null")
    num = F.col("kind") == "numeric"
    txt = F.col("kind") == "text"
    out = facts.where((F.col("non_null") > 0) & (F.col("kind") != "boolean")).select(
        "column",
        F.when(num & (F.col("negatives") > 0), F.col("negatives")).alias("negative_values"),
        F.when(num & (F.col("zeros") > 0), F.col("zeros")).alias("zero_values"),
        F.when(txt & (share >= NUMERIC_TEXT_SHARE), F.bround(share, 4)).alias("numeric_stored_as_text"),
        F.when(txt & (F.col("whitespace") > 0), F.col("whitespace")).alias("whitespace_values"))
    return out.where(F.coalesce("negative_values", "zero_values", "numeric_stored_as_text",
                                "whitespace_values").isNotNull())


def detect_inconsistent(df: DataFrame, examples: int = 5) -> DataFrame:
    """DQ-11: text values whose trim+lower form has more than one raw spelling.
    Per column: number of such groups and the first few normalised forms with
    their spellings (sorted)."""
    text_cols = [f.name for f in df.schema.fields if _kind(f.dataType) == "text"]
    if not text_cols:
        return df.sparkSession.createDataFrame([], "column string, inconsistent_groups long, examples string")
    long = unpivot(df, text_cols, value_type="string").where(F.col("value").isNotNull())
    d = long.distinct().withColumn("norm", F.lower(_stripped(F.col("value")))).persist()
    g = d.groupBy("column", "norm").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > 1)
    counts = g.groupBy("column").agg(F.count(F.lit(1)).alias("inconsistent_groups"))
    # the first few in two steps, so that no task ranks all groups of a column
    from pyspark.sql import Window
    salted = Window.partitionBy("column", F.pmod(F.hash("norm"), F.lit(64))).orderBy("norm")
    few = g.withColumn("r", F.row_number().over(salted)).where(F.col("r") <= examples)
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("column").orderBy("norm"))).where(F.col("r") <= examples).select("column", "norm")
    shown = (d.join(few, ["column", "norm"]).groupBy("column", "norm").agg(F.array_sort(F.collect_list("value")).alias("spellings"))
             .groupBy("column").agg(F.array_join(F.array_sort(F.collect_list(F.concat("norm", F.lit("="), F.array_join("spellings", "|")))), "; ").alias("examples")))
    return counts.join(shown, "column")


def detect_personal_data(facts: DataFrame) -> DataFrame:
    """DQ-12 (not scored): text columns where >= 50 % of non-empty values are
    e-mail addresses, else formatted phone numbers (all values, no head cut)."""
    em = F.col("emails") / F.col("nonblank")
    ph = F.col("phones") / F.col("nonblank")
    f = facts.where((F.col("kind") == "text") & (F.col("nonblank") > 0))
    return f.where((em >= PERSONAL_MIN_SHARE) | (ph >= PERSONAL_MIN_SHARE)).select(
        "column", F.when(em >= PERSONAL_MIN_SHARE, "email").otherwise("phone").alias("kind"),
        F.bround(F.when(em >= PERSONAL_MIN_SHARE, em).otherwise(ph), 3).alias("share"))


def quality_score(df: DataFrame, facts: DataFrame, dup: DataFrame, inconsistent: DataFrame,
                  issues: DataFrame) -> DataFrame:
    """DQ-13: 100 minus capped deductions; grade at 85 / 70 / 50. Inputs are
    the small per-column finding tables, so this is driver-cheap."""
    f = facts.agg(F.max("rows").alias("rows"), F.count(F.lit(1)).alias("cols"),
                  F.sum(F.col("nulls") + F.col("blanks")).alias("miss"),
                  F.count_if(F.col("n_distinct") <= 1).alias("const"))
    nb = issues.agg(F.count_if(F.col("numeric_stored_as_text").isNotNull()
                               | F.col("whitespace_values").isNotNull()).alias("broken"))
    ni = inconsistent.agg(F.count(F.lit(1)).alias("incons"))
    j = (f.withColumn("__k", F.lit(1)).join(dup.select("duplicate_percent").withColumn("__k", F.lit(1)), "__k")
         .join(nb.withColumn("__k", F.lit(1)), "__k").join(ni.withColumn("__k", F.lit(1)), "__k"))
    rows, cols = F.greatest(F.col("rows"), F.lit(1)), F.greatest(F.col("cols"), F.lit(1))
    d_miss = F.least(F.lit(30.0), 100.0 * F.col("miss") / (rows * cols) * 1.5)
    d_dup = F.least(F.lit(20.0), F.col("duplicate_percent") * 1.5)
    d_const = F.least(F.lit(15.0), 100.0 * F.col("const") / cols)
    d_inc = F.least(F.lit(20.0), 100.0 * F.col("incons") / cols)
    d_bad = F.least(F.lit(15.0), 100.0 * F.col("broken") / cols)
    score = F.bround(F.greatest(F.lit(0.0), 100.0 - d_miss - d_dup - d_const - d_inc - d_bad), 1)
    return j.select(score.alias("score"),
                    F.when(score >= 85, "good").when(score >= 70, "fair").when(score >= 50, "poor")
                    .otherwise("very poor").alias("grade"),
                    F.bround(d_miss, 1).alias("missing_points"), F.bround(d_dup, 1).alias("duplicate_points"),
                    F.bround(d_const, 1).alias("constant_points"), F.bround(d_inc, 1).alias("inconsistent_points"),
                    F.bround(d_bad, 1).alias("malformed_points"))


def quality_report(df: DataFrame) -> DataFrame:
    """DQ-14: every check on one shared facts pass; one row per check with
    issues_found and the number of findings (personal data not scored)."""
    facts = column_facts(df).persist()
    dup = detect_duplicates(df)
    checks = {
        "missing_values": detect_missing(facts),
        "outliers": detect_outliers(df),
        "constant_columns": facts.where(F.col("n_distinct") <= 1),
        "id_columns": detect_ids(facts),
        "high_cardinality": detect_high_cardinality(facts),
        "value_issues": detect_value_issues(facts),
        "consistency_issues": detect_inconsistent(df),
        "personal_data": detect_personal_data(facts),
    }
    found = dup.select(F.lit("duplicate_rows").alias("check"), F.col("duplicate_rows").cast("long").alias("findings"))
    for name, part in checks.items():  # one plan, not a job per check
        found = found.union(part.agg(F.lit(name).alias("check"), F.count(F.lit(1)).alias("findings")))
    return found.select("check", (F.col("findings") > 0).alias("issues_found"), "findings")
