"""Chart data (CHT-01..13): the numbers behind each chart, not the picture.

Samples (scatter, KDE input, missing map) are ordered by ``md5key(seed, key)``
and cut at n — deterministic, partition-independent and identical in DuckDB.
Everything else aggregates all rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import md5key, q
from ..functions.text import word_count
from .ranks import exact_quantiles

MAX_SCATTER = 5000
BAR_TOP = 10
BAR_OTHER_OVER = 50
PIE_MAX = 50
KDE_POINTS = 200
KDE_STEPS = 50  # bins in one bandwidth


def auto_bins(n: int, lo: float, hi: float, q1: float, q3: float) -> int:
    """numpy's 'auto' rule: bin width = min(Freedman-Diaconis, Sturges)
    (Sturges alone when the IQR is 0)."""
    if n < 1 or hi <= lo:
        return 1
    sturges = (hi - lo) / (math.log2(n) + 1.0)
    fd = 2.0 * (q3 - q1) * n ** (-1.0 / 3.0)
    width = min(fd, sturges) if fd > 0 else sturges
    return max(1, int(math.ceil((hi - lo) / width)))


def bin_expr(x, lo: float, hi: float, bins: int):
    """0-based equal-width bin over [lo, hi]; the top edge falls in the last bin."""
    if hi <= lo:
        return F.lit(0)
    return F.least(F.floor((x - F.lit(lo)) / F.lit(hi - lo) * F.lit(bins)), F.lit(bins - 1)).cast("int")


def histogram(df: DataFrame, col: str, bins: int | None = None, hue: str | None = None) -> DataFrame:
    """CHT-01: (hue,) bin, lo, hi, count. Bounds from one aggregate, the auto bin
    count from exact quartiles, then one groupBy."""
    x = q(col).cast("double")
    d = df.select(x.alias("v"), *([q(hue).cast("string").alias("hue")] if hue else [])).where(F.col("v").isNotNull())
    if bins is None:
        s = exact_quantiles(d.select("v"), [0.25, 0.75], value="v").first()
        b = d.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).first()
        if s is None or b["lo"] is None:
            return df.sparkSession.createDataFrame([], "bin int, lo double, hi double, count long")
        lo, hi = float(b["lo"]), float(b["hi"])
        bins = auto_bins(int(s["n"]), lo, hi, float(s["q_0"]), float(s["q_1"]))
    else:
        b = d.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).first()
        lo, hi = float(b["lo"]), float(b["hi"])
    width = (hi - lo) / bins if hi > lo else 0.0
    keys = (["hue"] if hue else []) + ["bin"]
    g = d.select(*(["hue"] if hue else []), bin_expr(F.col("v"), lo, hi, bins).alias("bin")).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"))
    return g.select(*keys, (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lo"),
                    (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("hi"), "count")


def box_stats(df: DataFrame, col: str, group: str | None = None) -> DataFrame:
    """CHT-03: per group q1, median, q3, whiskers (extreme values inside 1.5 IQR)
    and the number of fliers."""
    g = q(group).cast("string") if group else F.lit("all")
    d = df.select(g.alias("group"), q(col).cast("double").alias("v")).where(F.col("v").isNotNull())
    qs = exact_quantiles(d, [0.25, 0.5, 0.75], by=["group"], value="v").select(
        "group", "n", F.col("q_0").alias("q1"), F.col("q_1").alias("median"), F.col("q_2").alias("q3"))
    j = d.join(qs.select("group", "q1", "q3"), "group")
    lo = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))
    hi = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    w = j.groupBy("group").agg(F.min(F.when(F.col("v") >= lo, F.col("v"))).alias("whisker_low"),
                               F.max(F.when(F.col("v") <= hi, F.col("v"))).alias("whisker_high"),
                               F.count_if((F.col("v") < lo) | (F.col("v") > hi)).alias("fliers"))
    return qs.join(w, "group").select("group", F.col("n").cast("long"), "q1", "median", "q3", "whisker_low",
                                      "whisker_high", F.col("fliers").cast("long"))


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """PRJ-11 / CHT-05: seeded sample of exactly min(n, rows) rows without
    replacement: order by md5key(seed, key), keep n (per-partition top-n)."""
    return df.withColumn("__h", md5key(seed, q(key))).orderBy("__h").limit(n).drop("__h")


def kde(df: DataFrame, col: str, key: str, points: int = KDE_POINTS) -> DataFrame:
    """CHT-02: Gaussian KDE of all values with Scott's bandwidth h = sd * n^-1/5 on
    ``points`` grid positions from min - 3h to max + 3h. Values are counted in bins of
    h / KDE_STEPS first, so the kernels run over bins, not rows (``key`` is not needed any
    more and kept for callers)."""
    v = df.select(q(col).cast("double").alias("v")).where(F.col("v").isNotNull())
    st = v.agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("v").alias("sd"), F.min("v").alias("lo"),
               F.max("v").alias("hi")).first()
    n = int(st["n"])
    if n < 2 or not st["sd"]:
        return df.sparkSession.createDataFrame([], "x double, density double")
    h = float(st["sd"]) * n ** (-0.2)
    step = F.lit(h / KDE_STEPS)
    a, b = float(st["lo"]) - 3 * h, float(st["hi"]) + 3 * h
    bins = v.groupBy(F.floor((F.col("v") - F.lit(st["lo"])) / step).alias("bin")).agg(F.count(F.lit(1)).alias("k"), F.avg("v").alias("v"))
    grid = F.array(*[F.lit(a + (b - a) * i / (points - 1)) for i in range(points)])
    e = bins.select(F.explode(grid).alias("x"), "v", "k")
    kernel = F.col("k") * F.exp(-0.5 * F.pow((F.col("x") - F.col("v")) / F.lit(h), 2))
    return e.groupBy("x").agg((F.sum(kernel) / F.lit(n * h * math.sqrt(2 * math.pi))).alias("density"))


def line_means(df: DataFrame, x: str, y: str, hue: str | None = None) -> DataFrame:
    """CHT-06: mean of y per x (per hue)."""
    keys = [q(x).alias("x")] + ([q(hue).cast("string").alias("hue")] if hue else [])
    return (df.where(q(x).isNotNull() & q(y).isNotNull()).groupBy(*keys)
            .agg(F.avg(q(y).cast("double")).alias("mean"), F.count(F.lit(1)).alias("n")))


def bar_counts(df: DataFrame, col: str, top: int = BAR_TOP, other_over: int = BAR_OTHER_OVER) -> DataFrame:
    """CHT-07 / SRT-02: counts per value; beyond ``other_over`` distinct values
    the top ``top`` (count desc, value asc) are kept and the rest become 'Other'."""
    g = df.where(q(col).isNotNull()).groupBy(q(col).cast("string").alias("value")).agg(
        F.count(F.lit(1)).alias("count"))
    n_distinct = g.count()
    if n_distinct <= other_over:
        return g
    keep = g.orderBy(F.desc("count"), F.asc("value")).limit(top).select("value", F.lit(True).alias("__k"))
    j = g.join(F.broadcast(keep), "value", "left")
    return (j.select(F.when(F.col("__k"), F.col("value")).otherwise(F.lit("Other")).alias("value"), "count")
            .groupBy("value").agg(F.sum("count").alias("count")))


def pie_shares(df: DataFrame, col: str, max_values: int = PIE_MAX) -> DataFrame:
    """CHT-08: share of each value (<= 50 values, else refused)."""
    g = df.where(q(col).isNotNull()).groupBy(q(col).cast("string").alias("value")).agg(
        F.count(F.lit(1)).alias("count"))
    if g.limit(max_values + 1).count() > max_values:
        raise ValueError(f"a pie needs at most {max_values} values")
    tot = g.agg(F.sum("count").alias("t")).withColumn("__k", F.lit(1))
    return g.withColumn("__k", F.lit(1)).join(tot, "__k").select("value", "count",
                                                                 (F.col("count") / F.col("t")).alias("share"))


def text_lengths(df: DataFrame, col: str) -> DataFrame:
    """CHT-09: histogram of words per text (whole texts)."""
    return histogram(df.select(word_count(q(col)).alias("words")), "words")


def missing_map(df: DataFrame, key: str, n: int = 200, seed: int = 42) -> DataFrame:
    """CHT-10: for a seeded sample of rows, which of the columns with
    gaps are missing — long form (row key, column, missing)."""
    from ..functions.columns import is_missing
    cols = [c for c in df.columns if c != key]
    flags = df.agg(*[F.count_if(is_missing(q(c), df.schema[c].dataType)).alias(c) for c in cols]).first()
    gaps = [c for c in cols if flags[c] > 0]
    if not gaps:
        return df.sparkSession.createDataFrame([], "row_key string, column string, missing boolean")
    s = sample_rows(df, key, n, seed)
    st = ", ".join(f"'{c}', {c}__m" for c in gaps)
    wide = s.select(q(key).cast("string").alias("row_key"),
                    *[is_missing(q(c), df.schema[c].dataType).alias(f"{c}__m") for c in gaps])
    return wide.selectExpr("row_key", f"stack({len(gaps)}, {st}) as (column, missing)")
