"""Evaluation metrics and result-chart data (EVL-01..11, WIN-07/09, CHT-13).

Everything is computed over a predictions DataFrame (one row per scored row)
with aggregates: classification metrics from the k x k confusion counts,
ROC-AUC from global average ranks (rank-sum formula), average precision and
curve points from prefix sums over distinct scores in descending order.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dist
from ..functions.columns import q
from .ranks import average_ranks, prefix_sums

MAX_POINTS = 200
CALIBRATION_BINS = 10
MAX_CLASSES = 1000
EPS = 2.220446049250313e-16


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """EVL-08: (actual, predicted, count), zero-filled over the observed labels."""
    d = df.select(q(actual).cast("string").alias("actual"), q(predicted).cast("string").alias("predicted"))
    c = d.groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("count"))
    labels = [r[0] for r in d.select("actual").union(d.select("predicted")).distinct()
              .where(F.col("actual").isNotNull()).limit(MAX_CLASSES + 1).collect()]
    if len(labels) > MAX_CLASSES:
        raise ValueError("too many classes")
    lab = F.array(*[F.lit(x) for x in sorted(labels)])
    grid = (df.sparkSession.range(1).select(F.explode(lab).alias("actual"))
            .select("actual", F.explode(lab).alias("predicted")))
    return grid.join(c, ["actual", "predicted"], "left").select(
        "actual", "predicted", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def classification_metrics(df: DataFrame, actual: str, predicted: str, positive: str | None = None) -> DataFrame:
    """EVL-01/02: accuracy, balanced accuracy, precision, recall, specificity,
    F1 (binary: for ``positive``; otherwise macro), MCC, Cohen's kappa; zero
    division gives 0. The driver sees only the k x k counts."""
    cells = confusion(df, actual, predicted).collect()
    labels = sorted({c["actual"] for c in cells})
    k = len(labels)
    m = {(c["actual"], c["predicted"]): c["count"] for c in cells}
    unscored = (df.where(q(predicted).isNull() & q(actual).isNotNull())  # counted as wrong
                .groupBy(q(actual).cast("string").alias("a")).count().collect())
    none = dict.fromkeys(labels, 0) | {r["a"]: r["count"] for r in unscored}
    tot = sum(m.values()) + sum(none.values())
    t = {a: sum(m[(a, b)] for b in labels) + none[a] for a in labels}   # true counts
    p = {b: sum(m[(a, b)] for a in labels) for b in labels}   # predicted counts
    tp = {a: m[(a, a)] for a in labels}

    def div(a, b):
        return a / b if b else 0.0
    rec = {a: div(tp[a], t[a]) for a in labels}
    prec = {a: div(tp[a], p[a]) for a in labels}
    f1 = {a: div(2 * prec[a] * rec[a], prec[a] + rec[a]) for a in labels}
    spec = {a: div(tot - t[a] - p[a] + tp[a], tot - t[a]) for a in labels}
    if k == 2:
        pos = positive if positive in labels else labels[1]
        neg = [x for x in labels if x != pos][0]
        pr, rc, sp, f = prec[pos], rec[pos], rec[neg], f1[pos]
    else:
        pr, rc = sum(prec.values()) / k, sum(rec.values()) / k
        sp, f = sum(spec.values()) / k, sum(f1.values()) / k
    correct = sum(tp.values())
    acc = div(correct, tot)
    bal = sum(rec[a] for a in labels if t[a]) / max(1, sum(1 for a in labels if t[a]))
    num = correct * tot - sum(p[a] * t[a] for a in labels)
    guessed = [*p.values(), sum(none.values())]
    den = math.sqrt((tot * tot - sum(v * v for v in guessed)) * (tot * tot - sum(v * v for v in t.values())))
    mcc = num / den if den else 0.0
    pe = sum(p[a] * t[a] for a in labels) / (tot * tot) if tot else 0.0
    kappa = (acc - pe) / (1 - pe) if pe != 1 else 0.0
    return df.sparkSession.createDataFrame(
        [(int(tot), acc, bal, pr, rc, sp, f, mcc, kappa)],
        "n long, accuracy double, balanced_accuracy double, precision double, recall double, specificity double, "
        "f1 double, mcc double, kappa double")


def _score_table(df: DataFrame, label: str, score: str, positive=1) -> DataFrame:
    d = df.select((q(label) == F.lit(positive)).cast("long").alias("y"), q(score).cast("double").alias("s"))
    return d.where(F.col("s").isNotNull()).groupBy("s").agg(F.count(F.lit(1)).alias("n"),
                                                            F.sum("y").alias("npos"))


def roc_auc(df: DataFrame, label: str, score: str, positive=1) -> DataFrame:
    """EVL-03: AUC = (R+ - P(P+1)/2) / (P N) with average ranks of the scores."""
    t = _score_table(df, label, score, positive)
    r = average_ranks(t.select("s", "n"), "s", weight="n")
    j = t.join(r.select("s", "avg_rank"), "s")
    a = j.agg(F.sum(F.col("npos") * F.col("avg_rank")).alias("R"), F.sum("npos").alias("P"),
              F.sum(F.col("n") - F.col("npos")).alias("N"))
    return a.select(((F.col("R") - F.col("P") * (F.col("P") + 1) / 2) / (F.col("P") * F.col("N"))).alias("roc_auc"),
                    F.col("P").cast("long").alias("positives"), F.col("N").cast("long").alias("negatives"))


def _desc_cum(df, label, score, positive=1):
    t = _score_table(df, label, score, positive).withColumn("one", F.lit(1))
    return prefix_sums(t, "s", ["n", "npos", "one"], descending=True)


def average_precision(df: DataFrame, label: str, score: str, positive=1) -> DataFrame:
    """EVL-04: sum over distinct thresholds (descending) of
    (R_k - R_{k-1}) * P_k = (npos_k / P) * (cum_pos_k / cum_n_k)."""
    c = _desc_cum(df, label, score, positive)
    tot = c.agg(F.sum("npos").alias("P"))
    j = c.withColumn("__k", F.lit(1)).join(tot.withColumn("__k", F.lit(1)), "__k")
    return j.agg(F.sum(F.col("npos") / F.col("P") * F.col("cum_npos") / F.col("cum_n")).alias("pr_auc"))


def one_vs_rest(df: DataFrame, label: str, probabilities: dict[str, str]) -> DataFrame:
    """EVL-03 / EVL-04 for any number of classes: (class, positives, roc_auc, pr_auc) per class
    against the rest and the macro row (class null), the mean over the classes that have
    both positives and negatives. ``probabilities``: class -> its column. Rows become one (class,
    score) each, ties collapse, and one ranked pass by class serves both measures."""
    pairs = F.array(*[F.struct(F.lit(c).alias("class"), q(p).cast("double").alias("s"), (q(label).cast("string") == F.lit(c)).cast("long").alias("y")) for c, p in probabilities.items()])
    long = df.where(q(label).isNotNull()).select(F.explode(pairs).alias("e")).select("e.*").where(F.col("s").isNotNull())
    t = long.groupBy("class", "s").agg(F.count("*").alias("n"), F.sum("y").alias("npos"))
    c = prefix_sums(t, "s", ["n", "npos"], by=["class"], descending=True)
    tot = t.groupBy("class").agg(F.sum("n").alias("T"), F.sum("npos").alias("P"))
    rank = F.col("T") - F.col("cum_n") + (F.col("n") + 1) / 2  # ascending average rank of the ties
    j = c.join(F.broadcast(tot), "class").groupBy("class", "T", "P").agg(  # one row per class
        F.sum(F.col("npos") * rank).alias("R"), F.sum(F.col("npos") * F.col("cum_npos") / F.col("cum_n")).alias("A"))
    both = (F.col("P") > 0) & (F.col("P") < F.col("T"))
    per = j.select("class", F.col("P").alias("positives"),
                   F.when(both, (F.col("R") - F.col("P") * (F.col("P") + 1) / 2) / (F.col("P") * (F.col("T") - F.col("P")))).alias("roc_auc"), F.when(both, F.col("A") / F.col("P")).alias("pr_auc"))
    return per.unionByName(per.agg(F.lit(None).cast("string").alias("class"), F.sum("positives").alias("positives"), F.avg("roc_auc").alias("roc_auc"), F.avg("pr_auc").alias("pr_auc")))


def curve_points(df: DataFrame, label: str, score: str, positive=1, cap: int = MAX_POINTS) -> DataFrame:
    """EVL-09 + WIN-07/09: ROC (fpr, tpr) and PR (recall, precision) at every
    distinct threshold (descending), kept at <= cap evenly spaced positions."""
    c = _desc_cum(df, label, score, positive)
    tot = c.agg(F.sum("npos").alias("P"), F.sum(F.col("n") - F.col("npos")).alias("N"),
                F.count(F.lit(1)).alias("m")).first()
    pos_, neg_, m = int(tot["P"] or 0), int(tot["N"] or 0), int(tot["m"] or 0)
    keep = sorted({round(i * (m - 1) / (cap - 1)) for i in range(cap)}) if m > cap else None
    out = c.select(F.col("s").alias("threshold"), (F.col("cum_one") - 1).alias("idx"),
                   (F.col("cum_n") - F.col("cum_npos")) / F.lit(max(neg_, 1)) * F.lit(1.0),
                   F.col("cum_npos") / F.lit(max(pos_, 1)) * F.lit(1.0),
                   F.col("cum_npos") / F.col("cum_n"))
    out = out.toDF("threshold", "idx", "fpr", "tpr", "precision").withColumn("recall", F.col("tpr"))
    if keep is not None:
        out = out.where(F.col("idx").isin(keep))
    return out.select("threshold", F.col("idx").cast("long"), "fpr", "tpr", "recall", "precision")


def probability_losses(df: DataFrame, label: str, prob: str, positive=1) -> DataFrame:
    """EVL-05: log loss (probabilities clipped to [eps, 1-eps]) and Brier score."""
    y = (q(label) == F.lit(positive)).cast("double")
    p = F.least(F.greatest(q(prob).cast("double"), F.lit(EPS)), F.lit(1 - EPS))
    return df.agg(F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"),
                  F.avg(F.pow(q(prob).cast("double") - y, 2)).alias("brier"))


def regression_metrics(df: DataFrame, actual: str, predicted: str, n_features: int = 1) -> DataFrame:
    """EVL-06: MAE, MSE, RMSE, R2, adjusted R2, MAPE (null if a target is 0)."""
    y, p = q(actual).cast("double"), q(predicted).cast("double")
    d = df.select(y.alias("y"), p.alias("p")).dropna()
    a = d.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("y") - F.col("p"))).alias("mae"),
              F.avg(F.pow(F.col("y") - F.col("p"), 2)).alias("mse"), F.var_pop("y").alias("vy"),
              F.count_if(F.col("y") == 0).alias("zeros"),
              F.avg(F.abs(F.col("y") - F.col("p")) / F.greatest(F.abs("y"), F.lit(EPS))).alias("mape"))
    r2 = 1 - F.col("mse") / F.col("vy")
    return a.select(F.col("n").cast("long"), "mae", "mse", F.sqrt("mse").alias("rmse"), r2.alias("r2"),
                    F.when(F.col("n") - n_features - 1 > 0,
                           1 - (1 - r2) * (F.col("n") - 1) / (F.col("n") - n_features - 1)).alias("adj_r2"),
                    F.when(F.col("zeros") == 0, F.col("mape")).alias("mape"))


def calibration(df: DataFrame, label: str, prob: str, positive=1, bins: int = CALIBRATION_BINS) -> DataFrame:
    """EVL-10: uniform bins, right-closed (lo, hi], compared against the same
    edge values a linspace(0, 1, bins+1) gives; empty bins omitted."""
    edges = [i * (1.0 / bins) for i in range(1, bins)]
    p = q(prob).cast("double")
    b = sum((p > F.lit(e)).cast("int") for e in edges)
    y = (q(label) == F.lit(positive)).cast("double")
    return (df.where(p.isNotNull()).select(b.alias("bin"), p.alias("p"), y.alias("y"))
            .groupBy("bin").agg(F.avg("p").alias("predicted"), F.avg("y").alias("observed"),
                                F.count(F.lit(1)).alias("count")))


def residual_summary(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """EVL-11: residual mean and sd (n-1)."""
    r = (q(actual).cast("double") - q(predicted).cast("double"))
    return df.select(r.alias("r")).agg(F.count("r").alias("n"), F.avg("r").alias("residual_mean"),
                                       F.stddev_samp("r").alias("residual_sd"))


def residual_histogram(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """EVL-11 / CHT-01: residual histogram with numpy's 'auto' bin count
    (max of Sturges and Freedman-Diaconis), equal-width bins over [min, max]."""
    from .charts import histogram
    d = df.select((q(actual).cast("double") - q(predicted).cast("double")).alias("residual"))
    return histogram(d, "residual")


def qq_points(df: DataFrame, col: str, cap: int = MAX_POINTS) -> DataFrame:
    """WIN-08: normal Q-Q — ordered values against Filliben's order-statistic
    medians; positions by global rank (prefix sums), thinned to <= cap."""
    d = df.select(q(col).cast("double").alias("v")).where(F.col("v").isNotNull())
    t = d.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    c = prefix_sums(t, "v", ["n"]).select("v", "n", "cum_n")
    n = d.count()
    if n == 0:
        return df.sparkSession.createDataFrame([], "i long, theoretical double, sample double")
    # target positions (<= cap); a Bucketizer binary search counts how many of
    # them fall at or below each value's last position, so only the rows that
    # hold a target emit anything (a tie of any size is one row here)
    from pyspark.ml.feature import Bucketizer
    keep = sorted({round(k * (n - 1) / (cap - 1)) + 1 for k in range(cap)}) if n > cap else list(range(1, n + 1))
    splits = [float("-inf")] + [float(x) for x in keep] + [float("inf")]
    c = c.withColumn("hi", F.col("cum_n").cast("double")).withColumn("lo", (F.col("cum_n") - F.col("n")).cast("double"))
    c = Bucketizer(splits=splits, inputCol="hi", outputCol="bh").transform(c)
    c = Bucketizer(splits=splits, inputCol="lo", outputCol="bl").transform(c)
    karr = F.array(*[F.lit(x) for x in keep])
    pos = (c.where(F.col("bh") > F.col("bl"))
           .select("v", F.explode(F.sequence(F.col("bl").cast("int") + 1, F.col("bh").cast("int"))).alias("j"))
           .select("v", F.element_at(karr, F.col("j")).alias("i")))
    rows = pos.collect()  # <= cap rows
    last = 0.5 ** (1.0 / n)

    def med(i):
        if i == n:
            return last
        if i == 1:
            return 1 - last
        return (i - 0.3175) / (n + 0.365)
    out = [(int(r["i"]), dist.norm_ppf(med(int(r["i"]))), float(r["v"])) for r in rows]
    return df.sparkSession.createDataFrame(out, "i long, theoretical double, sample double")


def fold_summary(scores: DataFrame, by=("model", "metric"), value: str = "value") -> DataFrame:
    """EVL-07 / CHT-13: mean and sample sd across folds per (model, metric)."""
    return scores.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"),
                                   F.count(value).alias("folds"))


def _metrics_from_counts(cells: list[tuple], positive=None) -> dict:
    """Classification metrics from (actual, predicted, count) cells. Rows without an actual
    class do not count; rows without a prediction count as wrong."""
    cells = [c for c in cells if c[0] is not None]
    labels = sorted({a for a, _, _ in cells} | {p for _, p, _ in cells if p is not None})
    m = {(a, p): 0 for a in labels for p in [*labels, None]}
    for a, p, c in cells:
        m[(a, p)] += c
    k, tot = len(labels), sum(m.values())
    t = {a: sum(m[(a, b)] for b in [*labels, None]) for a in labels}
    pr = {b: sum(m[(a, b)] for a in labels) for b in labels}
    tp = {a: m[(a, a)] for a in labels}

    def div(x, y):
        return x / y if y else 0.0
    rec = {a: div(tp[a], t[a]) for a in labels}
    prec = {a: div(tp[a], pr[a]) for a in labels}
    f1 = {a: div(2 * prec[a] * rec[a], prec[a] + rec[a]) for a in labels}
    if k == 2:
        pos = positive if positive in labels else labels[1]
        f = f1[pos]
    else:
        f = sum(f1.values()) / max(k, 1)
    acc = div(sum(tp.values()), tot)
    bal = sum(rec[a] for a in labels if t[a]) / max(1, sum(1 for a in labels if t[a]))
    return {"accuracy": acc, "balanced_accuracy": bal, "f1": f}


def grouped_classification_metrics(pred: DataFrame, by: list[str], actual: str = "label",
                                   predicted: str = "prediction") -> dict:
    """EVL-01 for many (model, fold) groups from ONE grouped count
    (groups x classes^2 cells reach the driver)."""
    cells = (pred.groupBy(*by, q(actual).cast("string").alias("a"), q(predicted).cast("string").alias("p"))
             .agg(F.count(F.lit(1)).alias("c")).collect())
    groups: dict = {}
    for r in cells:
        groups.setdefault(tuple(r[b] for b in by), []).append((r["a"], r["p"], int(r["c"])))
    return {g: _metrics_from_counts(c) for g, c in groups.items()}


def grouped_roc_auc(pred: DataFrame, by: list[str], label: str = "label", score: str = "p1", positive=1.0) -> dict:
    """EVL-03 per group: rank-sum AUC with ranks computed within each group."""
    d = pred.select(*by, (q(label) == F.lit(positive)).cast("long").alias("y"), q(score).cast("double").alias("s"))
    t = d.where(F.col("s").isNotNull()).groupBy(*by, "s").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("npos"))
    r = average_ranks(t.select(*by, "s", "n"), "s", by=by, weight="n")
    a = (t.join(r.select(*by, "s", "avg_rank"), [*by, "s"])
         .groupBy(*by).agg(F.sum(F.col("npos") * F.col("avg_rank")).alias("R"), F.sum("npos").alias("P"),
                           F.sum(F.col("n") - F.col("npos")).alias("N")).collect())
    return {tuple(x[b] for b in by): ((x["R"] - x["P"] * (x["P"] + 1) / 2) / (x["P"] * x["N"]) if x["P"] and x["N"]
                                      else None) for x in a}
