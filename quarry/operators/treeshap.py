"""Exact path-dependent tree SHAP (EXP-04) and its dots (EXP-05).

With a set S of known features a tree expects the mean over its leaves in which a split on a
known feature follows the row and any other one follows both ways in the proportion of the
training rows (the nodes' covers). A leaf's share in that is a product over the distinct
features of its path, o_j (does the row pass all splits on j) for known features and z_j (the
product of the cover proportions) for others. For such a product the Shapley value of j is

    v (o_j - z_j) * integral over t in (0, 1) of prod_{i <> j} (z_i (1 - t) + o_i t)

because the integral of t^k (1-t)^(d-1-k) is the Shapley weight of a set of k out of d - 1. The
integrand is a polynomial of degree d - 1, so Gauss-Legendre nodes give it exactly. Forests and
boosted trees are weighted sums of trees. The model (its leaves) is broadcast, rows are scored
in batches where they are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import md5key, q
from ..session import cut_lineage
from .ranks import average_ranks

ROWS = 2048  # scored at once
TOP_COLUMNS = 10


class Leaf:
    """value, and per distinct feature of the path its cover proportion and its splits."""

    def __init__(self, value: float, share: float, path: list):
        self.value, self.share = value, share
        self.features: list[int] = []
        self.z: list[float] = []
        self.tests: list[list] = []
        for feature, proportion, test in path:
            if feature not in self.features:
                self.features.append(feature), self.z.append(1.0), self.tests.append([])
            i = self.features.index(feature)
            self.z[i] *= proportion
            self.tests[i].append(test)

    def passes(self, x: np.ndarray) -> np.ndarray:
        """(rows, features of the path): whether a row passes all splits on the feature."""
        out = np.ones((len(x), len(self.features)), bool)
        for i, (f, tests) in enumerate(zip(self.features, self.tests)):
            for kind, left, at in tests:
                goes_left = x[:, f] <= at if kind == "number" else np.isin(x[:, f], at)
                out[:, i] &= goes_left == left
        return out


def _leaves(tree, weight: float, value) -> list[Leaf]:
    """The leaves of one Spark tree with their paths."""
    out, todo = [], [(tree._java_obj.rootNode(), [])]
    whole = todo[0][0].impurityStats().count()
    while todo:
        node, path = todo.pop()
        n = node.impurityStats().count()
        if node.getClass().getSimpleName() == "LeafNode":
            out.append(Leaf(weight * value(node), n / whole, path))
            continue
        split = node.split()
        if split.getClass().getSimpleName() == "ContinuousSplit":
            test = ("number", float(split.threshold()))
        else:
            test = ("set", [float(c) for c in split.leftCategories()])
        for child, left in ((node.leftChild(), True), (node.rightChild(), False)):
            share = child.impurityStats().count() / n
            if share > 0:  # a way that no training row took has no part in any expectation
                todo.append((child, [*path, (split.featureIndex(), share, (test[0], left, test[1]))]))
    return out


def model_leaves(model, positive: int = 1) -> list[Leaf]:
    """Leaves of a spark.ml tree, forest or boosted model. Values: the probability of class
    ``positive`` for classification trees and forests, the prediction for regression, the margin
    (half the log odds) for boosted classifiers."""
    name = type(model).__name__

    def chance(node):
        stats = list(node.impurityStats().stats())
        return stats[positive] / sum(stats)

    number = lambda node: float(node.prediction())
    if name == "DecisionTreeClassificationModel":
        return _leaves(model, 1.0, chance)
    if name == "DecisionTreeRegressionModel":
        return _leaves(model, 1.0, number)
    if name.startswith("RandomForest"):
        value = chance if "Classification" in name else number
        return [leaf for t in model.trees for leaf in _leaves(t, 1.0 / len(model.trees), value)]
    if name.startswith("GBT"):
        return [leaf for t, w in zip(model.trees, model.treeWeights) for leaf in _leaves(t, float(w), number)]
    raise ValueError(f"no trees in {name}")


def shap_batch(leaves: list[Leaf], x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(phi (rows, features), output) of a batch of complete rows."""
    phi, output = np.zeros((len(x), width)), np.zeros(len(x))
    for leaf in leaves:
        d = len(leaf.features)
        if not d:
            output += leaf.value
            continue
        o, z = leaf.passes(x), np.array(leaf.z)
        output += leaf.value * o.all(axis=1)
        at, weight = np.polynomial.legendre.leggauss((d + 1) // 2)
        inner = np.zeros(o.shape)
        for t, w in zip((at + 1) / 2, weight / 2):
            factor = np.where(o, z * (1 - t) + t, z * (1 - t))  # positive: no cover is 0
            inner += w * factor.prod(axis=1, keepdims=True) / factor
        np.add.at(phi.T, leaf.features, (leaf.value * (o - z) * inner).T)
    return phi, output


def tree_shap(model, df: DataFrame, features: list[str], key: str, positive: int = 1) -> DataFrame:
    """(key, base, output, phi): per row the expected output, the row's output and one value per
    feature; base + sum(phi) = output. Rows with a gap in a feature have nulls."""
    leaves = model_leaves(model, positive)
    base = float(sum(leaf.value * leaf.share for leaf in leaves))
    shared = df.sparkSession.sparkContext.broadcast(leaves)  # the model
    kind = df.schema[key].dataType.simpleString()
    x = F.array(*[q(f).cast("double") for f in features])
    rows = df.select(q(key).alias("key"), x.alias("x"))
    gap = F.exists("x", lambda v: v.isNull() | F.isnan(v))

    def run(batches):
        for pdf in batches:
            for i in range(0, len(pdf), ROWS):
                part = pdf.iloc[i:i + ROWS]
                phi, out = shap_batch(shared.value, np.array(part["x"].tolist(), float), len(features))
                yield pd.DataFrame({"key": part["key"].to_numpy(), "output": out, "phi": list(phi)})

    done = rows.where(~gap).mapInPandas(run, f"key {kind}, output double, phi array<double>")
    rest = rows.where(gap).select("key", F.lit(None).cast("double").alias("output"), F.lit(None).cast("array<double>").alias("phi"))
    return done.unionByName(rest).select(q("key").alias(key), F.when(F.col("phi").isNotNull(), F.lit(base)).alias("base"), "output", "phi")


def shap_summary(shap: DataFrame, features: list[str]) -> DataFrame:
    """(feature, mean_abs_shap, place): mean |phi| over all rows, largest first."""
    sums = shap.agg(*[F.avg(F.abs(F.col("phi")[i])).alias(f"m{i}") for i in range(len(features))]).first()
    rows = sorted(((f, float(sums[f"m{i}"] or 0.0)) for i, f in enumerate(features)), key=lambda r: (-r[1], r[0]))
    return shap.sparkSession.createDataFrame([(f, m, k + 1) for k, (f, m) in enumerate(rows)], "feature string, mean_abs_shap double, place int")


def shap_dots(shap: DataFrame, df: DataFrame, features: list[str], key: str, rows: int = 1000, seed: int = 42, top: int = TOP_COLUMNS) -> DataFrame:
    """EXP-05: (feature, key, phi, value, position) for a seeded sample of rows and the ``top``
    features by mean |phi|; position is the value's percent rank among all rows, for colouring."""
    shap = cut_lineage(shap)
    table = cut_lineage(df.select(q(key).alias("key"), F.array(*[q(f).cast("double") for f in features]).alias("x")))
    first = [r["feature"] for r in shap_summary(shap, features).where(F.col("place") <= top).orderBy("place").collect()]
    sample = shap.where("phi is not null").withColumn("__h", md5key(seed, q(key))).orderBy("__h").limit(rows).drop("__h")
    sample = cut_lineage(sample.select(q(key).alias("key"), "phi"))
    shown = cut_lineage(table.join(F.broadcast(sample), "key"))  # ``rows`` rows, more where a key repeats

    def dots(f):
        i = features.index(f)
        values = table.select(F.col("x")[i].alias("value"))
        n = values.where("value is not null").count()
        ranks = average_ranks(values, "value").select(F.col("value").alias("__v"), "avg_rank")
        part = shown.select(q("key").alias(key), F.col("phi")[i].alias("phi"), F.col("x")[i].alias("value"))
        part = F.broadcast(part.select("value").distinct()).join(ranks, F.col("value") == F.col("__v")).select("__v", "avg_rank").join(F.broadcast(part), F.col("value") == F.col("__v"), "right")
        position = F.coalesce(F.col("avg_rank") / F.lit(float(max(n, 1))), F.lit(-1.0))
        return part.select(F.lit(f).alias("feature"), q(key), "phi", "value", position.alias("position"))

    out = None
    for f in first:
        part = cut_lineage(dots(f))
        out = part if out is None else out.unionByName(part)
    return out
