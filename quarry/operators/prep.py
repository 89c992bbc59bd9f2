"""Leak-free preprocessing: fit on TRAIN only, replay everywhere (FIT-*, PRE-*).

``fit_prep(train, plan)`` learns a small JSON-able state with a handful of
aggregates per plan stage (moments, exact quantiles, modes, category lists);
``transform(state, df)`` is column expressions only, so the same state
replays on test rows, new rows and streaming DataFrames (STR-01).

Splits, folds and resampling rank rows by ``uniform(seed, key)`` inside each
class with distributed prefix sums — no per-class sorted window, so a class
holding a third of the data is spread like any other — and are identical to
``row_number() over (partition by class order by md5(...))`` in SQL.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import is_numeric_type, q, uniform
from ..session import cut_lineage
from .ranks import exact_quantiles, prefix_sums, unpivot

ZSCORE_THRESHOLD = 3.0
WINSOR_LOWER, WINSOR_UPPER = 0.05, 0.95
IQR_K = 1.5
MAX_ONEHOT = 50
MOMENTS = {"mean", "sd_pop", "sd", "min", "max", "intlike"}  # found by one aggregate of all columns
LOCAL_CLASSES = 1000  # so many classes are kept as a local table
MAX_LEVELS = 100_000  # levels an ordinal code can number; more are refused
TOKEN_RE = r"[\p{L}\p{N}_]{2,}"   # maximal runs of 2+ word characters (Unicode)


# ---- fit / transform of per-column ops ------------------------------------------

def _num(c):
    return q(c).try_cast("double")


def _is_missing_val(df, c):
    if is_numeric_type(df.schema[c].dataType):
        return q(c).isNull()
    return q(c).isNull() | F.regexp_like(q(c).cast("string"), F.lit(r"^\s*$"))


def _stage_stats(df: DataFrame, needs: dict) -> dict:
    """needs: column -> set of statistic names; one moments aggregate, one
    exact-quantile pass, one mode pass, one category pass."""
    out = {c: {} for c in needs}
    mom = [c for c, s in needs.items() if s & MOMENTS]
    if mom:
        aggs = []
        for i, c in enumerate(mom):
            x = _num(c)
            aggs += [F.avg(x).alias(f"a{i}"), F.stddev_pop(x).alias(f"p{i}"), F.stddev_samp(x).alias(f"s{i}"),
                     F.min(x).alias(f"mn{i}"), F.max(x).alias(f"mx{i}"),
                     F.coalesce(F.bool_and(x % 1 == 0), F.lit(False)).alias(f"w{i}")]
        r = df.agg(*aggs).first()
        for i, c in enumerate(mom):
            out[c].update(mean=r[f"a{i}"], sd_pop=r[f"p{i}"], sd=r[f"s{i}"], min=r[f"mn{i}"], max=r[f"mx{i}"],
                          intlike=bool(r[f"w{i}"]) and r[f"a{i}"] is not None)
    qcols = {c: sorted(p for p in s if isinstance(p, float)) for c, s in needs.items()}
    qcols = {c: p for c, p in qcols.items() if p}
    if qcols:
        probs = sorted({p for ps in qcols.values() for p in ps})
        long = unpivot(df, list(qcols))
        for r in exact_quantiles(long, probs, by=["column"]).collect():
            for i, p in enumerate(probs):
                out[r["column"]][p] = r[f"q_{i}"]
    mcols = [c for c, s in needs.items() if "mode" in s]
    for c in mcols:  # one groupBy per column; only the smallest mode reaches the driver
        num = is_numeric_type(df.schema[c].dataType)
        v = _num(c) if num else F.when(~_is_missing_val(df, c), q(c).cast("string"))
        g = df.select(v.alias("v")).where(F.col("v").isNotNull()).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        r = g.orderBy(F.desc("n"), F.asc("v")).limit(1).collect()
        out[c]["mode"] = r[0]["v"] if r else None
    ccols = [c for c, s in needs.items() if "categories" in s]
    for c in ccols:
        vals = [r[0] for r in df.where(q(c).isNotNull()).select(q(c).cast("string")).distinct()
                .limit(MAX_ONEHOT + 1).collect()]
        if len(vals) > MAX_ONEHOT:
            raise ValueError(f"'{c}' has more than {MAX_ONEHOT} categories - one-hot refused.")
        out[c]["categories"] = sorted(vals)
    return out


def _needs(op: dict) -> set:
    kind = op["op"]
    if kind == "impute":
        s = op.get("strategy", "median")
        return {"intlike", "mean"} | ({0.5} if s == "median" else set()) | ({"mode"} if s == "most_frequent" else set())
    if kind == "scale":
        m = op.get("method", "standard")
        return {"mean", "sd_pop"} if m == "standard" else {0.25, 0.5, 0.75} if m == "robust" else {"min", "max"}
    if kind == "outliers":
        m = op.get("method", "clip_iqr")
        if m == "zscore":
            return {"intlike", "mean", "sd"}
        if m == "winsorize":
            return {"intlike", float(op.get("lower", WINSOR_LOWER)), float(op.get("upper", WINSOR_UPPER))}
        return {"intlike", 0.25, 0.75}
    if kind == "encode":
        return {"categories"} if op.get("method", "onehot") == "onehot" else set()
    raise ValueError(f"unknown prep op {kind}")


def _fit_one(op, c, st, df, key):
    kind = op["op"]
    if kind == "impute":
        s = op.get("strategy", "median")
        if s == "mean":
            fill = st.get("mean")
        elif s == "median":
            fill = st.get(0.5)
        elif s == "most_frequent":
            fill = st.get("mode") if st.get("mode") is not None else 0
        else:
            fill = op.get("fill_value", 0 if st.get("intlike") else "Missing")
        return {"fill": fill, "intlike": bool(st.get("intlike")) and s != "mean"}
    if kind == "scale":
        m = op.get("method", "standard")
        if m == "standard":
            sd = st["sd_pop"] or 0.0
            return {"center": st["mean"], "scale": sd if sd else 1.0}
        if m == "robust":
            iqr = (st[0.75] - st[0.25]) if st.get(0.75) is not None else 0.0
            return {"center": st[0.5], "scale": iqr if iqr else 1.0}
        rng = (st["max"] - st["min"]) if st.get("max") is not None else 0.0
        return {"center": st["min"], "scale": rng if rng else 1.0}
    if kind == "outliers":
        m = op.get("method", "clip_iqr")
        if m == "zscore":
            z = float(op.get("threshold", ZSCORE_THRESHOLD))
            sd = st.get("sd")
            lo, hi = (st["mean"] - z * sd, st["mean"] + z * sd) if sd else (None, None)
        elif m == "winsorize":
            lo, hi = st.get(float(op.get("lower", WINSOR_LOWER))), st.get(float(op.get("upper", WINSOR_UPPER)))
        else:
            k = float(op.get("k", IQR_K))
            q1, q3 = st.get(0.25), st.get(0.75)
            iqr = (q3 - q1) if q1 is not None else 0.0
            lo, hi = (q1 - k * iqr, q3 + k * iqr) if iqr else (None, None)
        return {"low": lo, "high": hi, "intlike": bool(st.get("intlike"))}
    if kind == "encode":
        m = op.get("method", "onehot")
        if m == "onehot":
            return {"categories": st["categories"]}
        if m == "ordinal":
            order = list(op.get("order") or [])
            if key is None:
                raise ValueError("ordinal encoding by first appearance needs a row key")
            firsts = (df.where(q(c).isNotNull()).groupBy(q(c).cast("string").alias("v"))
                      .agg(F.min(q(key)).alias("k")).orderBy("k").limit(MAX_LEVELS + 1).collect())
            if len(firsts) > MAX_LEVELS:
                raise ValueError(f"{c}: more than {MAX_LEVELS} levels to number")
            codes = {v: i for i, v in enumerate(order)}
            for r in firsts:
                codes.setdefault(r["v"], len(codes))
            return {"codes": codes}
    raise ValueError(f"unknown op {op}")


def _apply_one(op, c, st, df: DataFrame) -> DataFrame:
    kind = op["op"]
    cols = [x for x in df.columns]
    if kind == "impute":
        if is_numeric_type(df.schema[c].dataType) or isinstance(st["fill"], (int, float)):
            x = _num(c)
            e = F.coalesce(x, F.lit(st["fill"]).cast("double"))
            e = F.round(e).cast("long") if st["intlike"] else e
        else:
            e = F.when(_is_missing_val(df, c), F.lit(str(st["fill"]))).otherwise(q(c).cast("string"))
        return df.select(*[(e.alias(x) if x == c else q(x)) for x in cols])
    if kind == "scale":
        e = (_num(c) - F.lit(st["center"])) / F.lit(st["scale"])
        return df.select(*[(e.alias(x) if x == c else q(x)) for x in cols])
    if kind == "outliers":
        if op.get("method") == "remove_rows":
            return df
        e = _num(c)
        if st["low"] is not None:
            e = F.greatest(e, F.lit(st["low"]))
        if st["high"] is not None:
            e = F.least(e, F.lit(st["high"]))
        e = F.when(_num(c).isNull(), F.lit(None).cast("double")).otherwise(e)
        e = F.round(e).cast("long") if st["intlike"] else e
        return df.select(*[(e.alias(x) if x == c else q(x)) for x in cols])
    if kind == "encode":
        if "categories" in st:
            s = q(c).cast("string")
            dummies = [F.coalesce((s == F.lit(v)).cast("long"), F.lit(0)).alias(f"{c}_{v}") for v in st["categories"]]
            i = cols.index(c)
            return df.select(*[q(x) for x in cols[:i]], *dummies, *[q(x) for x in cols[i + 1:]])
        m = F.create_map(*[x for k, v in st["codes"].items() for x in (F.lit(k), F.lit(v))])
        e = F.coalesce(F.element_at(m, q(c).cast("string")), F.lit(-1)).cast("long")
        return df.select(*[(e.alias(x) if x == c else q(x)) for x in cols])
    raise ValueError(kind)


def fit_prep(train: DataFrame, plan: dict, key: str | None = None) -> dict:
    """plan: {column: [op, ...]} -> state {column: [(op, learned), ...]}.
    Stage i fits the i-th op of every column from the train rows as the
    earlier stages left them (same order as applying them). Where more than one aggregate is
    needed, the columns that matter are stored first: none repeats the work behind ``train``."""
    for c in plan:
        if c not in train.columns:
            raise ValueError(f"'{c}' is not a column")
    state = {c: [] for c in plan}
    depth = max((len(v) for v in plan.values()), default=0)
    stages = [{c: ops[i] for c, ops in plan.items() if len(ops) > i} for i in range(depth)]
    cur = train.select(*[q(c) for c in train.columns if c in plan or c == key]) if depth else train
    if depth > 1 or any(not _needs(op) or _needs(op) - MOMENTS for stage in stages for op in stage.values()):
        cur = cut_lineage(cur)
    for i, stage in enumerate(stages):
        needs = {c: _needs(op) for c, op in stage.items()}
        stats = _stage_stats(cur, needs)
        for c, op in stage.items():
            learned = _fit_one(op, c, stats[c], cur, key)
            state[c].append([op, learned])
        for c, op in stage.items():
            cur = _apply_one(op, c, state[c][-1][1], cur)
    return state


def transform(state: dict, df: DataFrame) -> DataFrame:
    """FIT-18 / STR-01: replay learned state; column expressions only, one
    output row per input row, valid on streaming DataFrames."""
    depth = max((len(v) for v in state.values()), default=0)
    for i in range(depth):
        for c, steps in state.items():
            if len(steps) > i and c in df.columns:
                op, learned = steps[i]
                df = _apply_one(op, c, learned, df)
    return df


def remove_outlier_rows(train: DataFrame, columns: list[str], k: float = IQR_K) -> DataFrame:
    """FIT-11: drop TRAIN rows outside Tukey fences, column after column with
    the bounds recomputed on what is left; missing values are kept."""
    cur = train
    for c in columns:
        r = exact_quantiles(cur.select(_num(c).alias("value")), [0.25, 0.75]).first()
        if r is None or r["q_0"] is None:
            continue
        iqr = r["q_1"] - r["q_0"]
        if not iqr:
            continue
        lo, hi = r["q_0"] - k * iqr, r["q_1"] + k * iqr
        cur = cur.where(q(c).isNull() | _num(c).between(lo, hi))
    return cur


# ---- ranks inside classes: splits, folds, resampling -------------------------------

def class_ranks(df: DataFrame, key: str, seed: int = 42, by: list[str] | tuple = ()) -> DataFrame:
    """Adds ``__u`` (uniform(seed, key)) and ``__rank`` (1-based rank of __u
    within ``by``) to every row, via prefix sums + a join on (by, __u)."""
    by = list(by)
    d = df.withColumn("__u", uniform(seed, q(key)))
    cnt = d.groupBy(*by, "__u").agg(F.count(F.lit(1)).alias("n"))
    r = prefix_sums(cnt, "__u", ["n"], by, even=True).select(*by, "__u", F.col("cum_n").alias("__rank"))
    return d.join(r, on=[*by, "__u"], how="inner")


def _class_col(df, stratify):
    return q(stratify).cast("string") if stratify else F.lit("__all")


def split(df: DataFrame, key: str, test_size: float = 0.2, seed: int = 42, stratify: str | None = None) -> DataFrame:
    """PRE-13: locked reproducible split, exact sizes: within each class (or
    overall) the round(test_size * n) rows with the smallest md5 key are test."""
    if not 0.05 <= test_size <= 0.5:
        raise ValueError("test_size must be between 0.05 and 0.5")
    d = df.withColumn("__c", _class_col(df, stratify))
    sizes = d.groupBy("__c").agg(F.count(F.lit(1)).alias("__n"))
    few = sizes.limit(LOCAL_CLASSES + 1).collect()
    small = any(r["__n"] < 2 for r in few) or len(few) > LOCAL_CLASSES and sizes.where("__n < 2").limit(1).count()
    if stratify and small:
        d = d.withColumn("__c", F.lit("__all"))
        sizes = d.groupBy("__c").agg(F.count(F.lit(1)).alias("__n"))
        few = sizes.collect()
    if len(few) <= LOCAL_CLASSES:  # sent to every task: a shuffle by class alone would leave a class in one task
        sizes = F.broadcast(df.sparkSession.createDataFrame([tuple(r) for r in few], "__c string, __n long"))
    r = class_ranks(d, key, seed, ["__c"]).join(sizes, "__c")
    k = F.bround(F.col("__n") * F.lit(float(test_size)), 0)
    return r.withColumn("__split__", F.when(F.col("__rank") <= k, "test").otherwise("train")).drop(
        "__c", "__u", "__rank", "__n")


def split_grouped(df: DataFrame, group: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """PRE-14: whole groups go to one side; test = the round(test_size * G)
    groups with the smallest md5 key."""
    g = df.select(q(group).alias("__g")).where(F.col("__g").isNotNull()).distinct()
    ng = g.count()
    kt = int(round(test_size * ng))
    rg = class_ranks(g, "__g", seed).select("__g", (F.col("__rank") <= kt).alias("__t"))
    out = df.join(rg, q(group) == F.col("__g"), "left")
    return out.withColumn("__split__", F.when(F.col("__t"), "test").otherwise("train")).drop("__g", "__t")


def assign_folds(df: DataFrame, key: str, k: int = 5, seed: int = 42, stratify: str | None = None,
                 group: str | None = None) -> DataFrame:
    """PRE-15: fold = (rank within class - 1) mod k (stratified or plain);
    grouped: the rank of the group mod k."""
    if group:
        g = df.select(q(group).alias("__g")).distinct()
        rg = class_ranks(g, "__g", seed).select("__g", F.pmod(F.col("__rank") - 1, F.lit(k)).cast("int").alias("fold"))
        return df.join(rg, q(group) == F.col("__g"), "left").drop("__g")
    d = df.withColumn("__c", _class_col(df, stratify))
    r = class_ranks(d, key, seed, ["__c"])
    return r.withColumn("fold", F.pmod(F.col("__rank") - 1, F.lit(k)).cast("int")).drop("__c", "__u", "__rank")


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """PRE-09: n / (k * n_c), rounded to 3."""
    g = df.where(q(target).isNotNull()).groupBy(q(target).cast("string").alias("class")).agg(
        F.count(F.lit(1)).alias("n_c"))
    t = g.agg(F.sum("n_c").alias("n"), F.count(F.lit(1)).alias("k")).withColumn("__k", F.lit(1))
    return g.withColumn("__k", F.lit(1)).join(t, "__k").select(
        "class", F.col("n_c").cast("long"), F.round(F.col("n") / (F.col("k") * F.col("n_c")), 3).alias("weight"))


def resample(df: DataFrame, target: str, key: str, method: str = "oversample", seed: int = 42) -> DataFrame:
    """PRE-10: every class to the largest (oversample: whole copies plus the
    lowest-ranked rest) or smallest (undersample: lowest-ranked rows) count."""
    d = df.withColumn("__c", q(target).cast("string")).where(F.col("__c").isNotNull())
    sizes = d.groupBy("__c").agg(F.count(F.lit(1)).alias("__n"))
    lim = sizes.agg(F.max("__n").alias("mx"), F.min("__n").alias("mn")).first()
    r = class_ranks(d, key, seed, ["__c"]).join(sizes, "__c")
    if method == "undersample":
        out = r.where(F.col("__rank") <= F.lit(int(lim["mn"])))
    else:
        mx = F.lit(int(lim["mx"]))
        copies = F.floor(mx / F.col("__n")) + F.when(F.col("__rank") <= F.pmod(mx, F.col("__n")), 1).otherwise(0)
        out = r.withColumn("__copy", F.explode(F.sequence(F.lit(1), copies.cast("int"))))
        return out.drop("__c", "__u", "__rank", "__n")
    return out.drop("__c", "__u", "__rank", "__n")


# ---- feature selection -----------------------------------------------------------

def _k_of(k, p):
    if k < 1:
        return max(1, int(math.ceil(k * p)))
    return min(int(k), p)


def select_features(df: DataFrame, features: list[str], target: str, method: str = "anova", k: float = 5,
                    task: str = "classification") -> DataFrame:
    """PRE-04/05/06: per-feature score, top-k flag (k < 1 = share, ceil).
    correlation: |Pearson| with the target code; chi2: features shifted by
    their minimum, observed per-class sums vs class-share expectation; anova: one-way F
    (classification) or F of r^2 (regression)."""
    p = len(features)
    kk = _k_of(k, p)
    y = q(target)
    if method == "correlation" or task == "regression":
        d = (df.where(y.isNotNull()).withColumn("__y", y.cast("double")) if task == "regression"
             else _code_target(df, target))
        aggs = [F.corr(_num(f), F.col("__y")).alias(f"r{i}") for i, f in enumerate(features)]
        aggs.append(F.count(F.lit(1)).alias("n"))
        r = d.agg(*aggs).first()
        n = r["n"]
        rows = []
        for i, f in enumerate(features):
            rv = r[f"r{i}"] or 0.0
            if method == "correlation":
                rows.append((f, abs(rv)))
            else:
                rows.append((f, rv * rv / (1 - rv * rv) * (n - 2) if abs(rv) < 1 else float("inf")))
    elif method == "chi2":
        mins = df.agg(*[F.min(_num(f)).alias(f"m{i}") for i, f in enumerate(features)]).first()
        shifted = [(_num(f) - F.lit(mins[f"m{i}"] or 0.0)) for i, f in enumerate(features)]
        g = (df.where(y.isNotNull()).groupBy(y.cast("string").alias("c"))
             .agg(F.count(F.lit(1)).alias("n"), *[F.sum(s).alias(f"s{i}") for i, s in enumerate(shifted)]).collect())
        n = sum(r["n"] for r in g)
        rows = []
        for i, f in enumerate(features):
            tot = sum((r[f"s{i}"] or 0.0) for r in g)
            chi = 0.0
            for r in g:
                e = r["n"] / n * tot
                chi += ((r[f"s{i}"] or 0.0) - e) ** 2 / e if e else 0.0
            rows.append((f, chi))
    else:
        g = (df.where(y.isNotNull()).groupBy(y.cast("string").alias("c"))
             .agg(F.count(F.lit(1)).alias("n"), *[F.avg(_num(f)).alias(f"a{i}") for i, f in enumerate(features)],
                  *[F.var_samp(_num(f)).alias(f"v{i}") for i, f in enumerate(features)]).collect())
        n, kc = sum(r["n"] for r in g), len(g)
        rows = []
        for i, f in enumerate(features):
            grand = sum(r["n"] * r[f"a{i}"] for r in g) / n
            ssb = sum(r["n"] * (r[f"a{i}"] - grand) ** 2 for r in g)
            ssw = sum((r["n"] - 1) * (r[f"v{i}"] or 0.0) for r in g)
            rows.append((f, (ssb / (kc - 1)) / (ssw / (n - kc)) if ssw else 0.0))
    order = sorted(rows, key=lambda t: (-t[1], features.index(t[0])))
    chosen = {f for f, _ in order[:kk]}
    return df.sparkSession.createDataFrame([(f, float(s), f in chosen) for f, s in rows],
                                           "feature string, score double, selected boolean")


def _code_target(df, target):
    """Class codes for correlation scoring: classes sorted, 0..k-1 (for two
    classes |r| does not depend on the coding)."""
    from .models import class_codes
    known = class_codes(df, target).select(F.col("value").alias("__value"), F.col("label").alias("__y"))
    return df.join(known, q(target).cast("string") == F.col("__value")).drop("__value")


def mutual_info(df: DataFrame, features: list[str], target: str, bins: int = 10) -> DataFrame:
    """PRE-07 (re-aimed): mutual information between equal-frequency bins of
    each feature and the class: sum p(x,y) ln(p(x,y) / (p(x) p(y)))."""
    long = unpivot(df.where(q(target).isNotNull()), features, by=[target])
    probs = [i / bins for i in range(1, bins)]
    cuts = {r["column"]: [r[f"q_{i}"] for i in range(len(probs))]
            for r in exact_quantiles(long, probs, by=["column"]).collect()}
    parts = []
    for f in features:
        edges = cuts.get(f) or []
        b = sum((_num(f) > F.lit(e)).cast("int") for e in edges) if edges else F.lit(0)
        parts.append(df.where(q(target).isNotNull() & q(f).isNotNull()).select(
            F.lit(f).alias("feature"), b.alias("x"), q(target).cast("string").alias("y")))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    j = u.groupBy("feature", "x", "y").agg(F.count(F.lit(1)).alias("nxy"))
    w_f, w_x, w_y = (Window.partitionBy("feature"), Window.partitionBy("feature", "x"),
                     Window.partitionBy("feature", "y"))
    j = (j.withColumn("n", F.sum("nxy").over(w_f)).withColumn("nx", F.sum("nxy").over(w_x))
         .withColumn("ny", F.sum("nxy").over(w_y)))
    return j.groupBy("feature").agg(F.sum(F.col("nxy") / F.col("n") * F.log(F.col("nxy") * F.col("n")
                                                                        / (F.col("nx") * F.col("ny")))).alias("mi"))


# ---- TF-IDF (long form) -----------------------------------------------------------

def word_tokens(text):
    """Lower-cased maximal runs of >= 2 word characters (Unicode)."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({TOKEN_RE})"), 1)


def word_ngrams(df: DataFrame, key: str, text: str, n_max: int = 2, keep: list[str] | tuple = ()) -> DataFrame:
    """(key, term[, keep...]) for every 1..n_max-gram occurrence of the whole text, tokenised once.
    Texts go to the task of their key first: counting a document's terms and joining by document
    then move no terms, which are many times the texts."""
    toks = df.repartition(q(key)).select(q(key).alias("doc"), *[q(c) for c in keep], word_tokens(q(text)).alias("t"))

    def grams(n):
        if n == 1:
            return F.col("t")
        joined = F.transform(F.slice("t", F.lit(1), F.size("t") - (n - 1)), lambda x, i: F.concat_ws(" ", x, *[F.get("t", i + k) for k in range(1, n)]))
        return F.when(F.size("t") >= n, joined).otherwise(F.array().cast("array<string>"))

    every = F.concat(*[grams(n) for n in range(1, n_max + 1)]) if n_max > 1 else grams(1)
    # the outer form: the plain one is preceded by a filter that works the terms out once more
    return toks.select("doc", *keep, F.explode_outer(every).alias("term")).where("term is not null")


def char_wb_ngrams(df: DataFrame, key: str, text: str, n_min: int = 3, n_max: int = 5) -> DataFrame:
    """(key, term) for char n-grams inside space-padded words; a padded word no longer than n
    yields itself once, at the first such n, and nothing for larger ones."""
    words = df.select(q(key).alias("doc"), F.explode(F.split(F.trim(F.lower(F.coalesce(q(text), F.lit("")))),
                                                             r"\s+")).alias("w")).where(F.length("w") > 0)
    padded = words.select("doc", F.concat(F.lit(" "), "w", F.lit(" ")).alias("w"))

    def grams(n):
        cut = F.transform(F.sequence(F.lit(0), F.greatest(F.length("w") - n, F.lit(0))), lambda o: F.substring(F.col("w"), o + 1, n))
        return cut if n == n_min else F.when(F.length("w") >= n, cut).otherwise(F.array().cast("array<string>"))

    return padded.select("doc", F.explode(F.concat(*[grams(n) for n in range(n_min, n_max + 1)])).alias("term"))


def term_counts(terms: DataFrame, keep: list[str] | tuple = ()) -> DataFrame:
    """(doc, term, tf[, keep...]) — one row per document and term (one shuffle)."""
    return terms.groupBy("doc", "term", *keep).agg(F.count(F.lit(1)).alias("tf"))


def tfidf_fit(tf: DataFrame, n: int, min_docs: int = 1) -> DataFrame:
    """idf = ln((1 + n) / (1 + df)) + 1 over the ``n`` TRAIN documents, those without a
    token included (smooth idf); ``tf`` holds one row per (doc, term), so df is a plain
    count per term. Terms of fewer than ``min_docs`` of them are left out."""
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_docs).select(
        "term", (F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + 1).alias("idf"))


def tfidf_raw(tf: DataFrame, idf: DataFrame, name: str = "term") -> DataFrame:
    """(doc, name, w): the weights of ``tfidf_transform`` before they are normalised."""
    return tf.join(idf, "term").select("doc", name, ((1 + F.log("tf")) * F.col("idf")).alias("w"))


def tfidf_transform(tf: DataFrame, idf: DataFrame, name: str = "term") -> DataFrame:
    """(doc, term, weight): sublinear tf 1 + ln(tf) times idf, L2-normalised
    per document; terms unseen at fit time are dropped. ``name`` may be another column of
    ``idf`` that stands for the term in the result."""
    w = tfidf_raw(tf, idf, name)
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc")))  # a document's distinct terms
    return w.select("doc", name, (F.col("w") / norm).alias("weight"))


def pca(train: DataFrame, features: list[str], k: int | float = 2, scale: bool = False):
    """PRE-12: centred (optionally standardised) PCA fitted on TRAIN; k < 1 =
    smallest number of components reaching that explained-variance share.
    Returns (model state, transform function)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector
    st = _stage_stats(train, {f: {"mean", "sd"} for f in features})
    numbers = lambda values: F.lit(np.array(list(values), float))  # noqa: E731 - one array literal
    centre = numbers(st[f]["mean"] for f in features)
    spread = numbers(st[f]["sd"] if scale and st[f]["sd"] else 1.0 for f in features)

    def scaled(df):
        """The standardised coordinates as one array, null where one is missing."""
        x = F.array(*[_num(f) for f in features])
        z = F.zip_with(F.zip_with(x, centre, lambda v, m: v - m), spread, lambda v, sd: v / sd)
        return F.when(~F.exists(x, lambda v: v.isNull() | F.isnan(v)), z)

    # components come from complete rows; other rows get null coordinates
    whole = train.select(scaled(train).alias("__z")).where("__z is not null").select(array_to_vector("__z").alias("__x"))
    full = PCA(k=len(features), inputCol="__x", outputCol="__pc").fit(whole)
    ev = list(full.explainedVariance)
    if k < 1:
        acc, n = 0.0, 0
        for v in ev:
            acc += v
            n += 1
            if acc >= k:
                break
    else:
        n = int(min(k, len(features)))
    comps = full.pc.toArray()[:, :n]

    def apply(df: DataFrame) -> DataFrame:
        rest = [q(c) for c in df.columns if c not in features]
        part = lambda j: F.aggregate(F.zip_with("__z", numbers(comps[:, j]), lambda v, w: v * w), F.lit(0.0), lambda a, v: a + v)
        return df.select(*rest, scaled(df).alias("__z")).select(*rest, *[part(j).alias(f"pc{j + 1}") for j in range(n)])
    return {"components": n, "explained_variance": ev[:n]}, apply
