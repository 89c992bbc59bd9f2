"""Operator 11: quality classifier, a factorisation machine over hashed words, structure
statistics and metadata.

score = 1 / (1 + exp(-(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j))); the pairwise sum is
worked out in linear time as half of sum_f (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2, in
training and in scoring (spark.ml's factorisation machine). The features come from the whole
text: word presence in 2^14 hashed buckets, scaled to length
``WORD_WEIGHT`` per text; structure statistics; and the metadata column n_chars (its size, whether
it is missing, whether it differs from the text's length). Statistics and metadata are centred
and scaled by the sample's mean and deviation and cut to +-``CUT`` deviations.

Fitted on at most ``SAMPLE`` distinct labelled texts (those with the smallest checksums, so
the choice does not depend on partitions); copies of a text count once, texts with
contradicting labels teach nothing, nor do null labels or null ids. With one label only, or
none, every score is that label's smoothed share (0.5 without any). Null and empty texts have
zero words and are scored by their other features. Labels, lang, source and doc_id are never
features. Repeated rows are scored each; columns beside doc_id, text, n_chars are ignored.
"""

from __future__ import annotations

import math
from operator import eq

import numpy as np
import pandas as pd
from pyspark.ml.feature import ElementwiseProduct, HashingTF, Normalizer, VectorAssembler
from pyspark.ml.classification import FMClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, use_small_batches

SAMPLE = 20_000  # distinct texts used for fitting at most
BUCKETS = 1 << 14
WORD_WEIGHT = 0.03
CUT = 2.0
FACTORS = 4
ROUNDS = 60
STEP = 0.05
DECAY = 1e-3
ACCEPT = 0.3
FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """Whether a document is left out of fitting; false without an id."""
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


#: Characters counted together, as shares of the text.
CLASSES = (str.isupper, str.isalpha, str.isnumeric, str.isspace, "#$%&*".__contains__, "|\\/<>{}[]".__contains__, "^~=_+@".__contains__, "!".__contains__, "?".__contains__, ".,;:".__contains__)
_CLASS_OF: list[np.ndarray] = []


def class_of() -> np.ndarray:
    """The class of every code point: the first that holds, else one more."""
    if not _CLASS_OF:
        _CLASS_OF.append(np.fromiter((next((i for i, c in enumerate(CLASSES) if c(chr(p))), len(CLASSES)) for p in range(0x110000)), np.uint8, 0x110000))
    return _CLASS_OF[0]


def scale(n: float) -> float:
    return min(1.0, math.log1p(max(n, 0)) / math.log(1e8))


def text_statistics(text: str | None, n_chars: int | None) -> list[float]:
    """Structure statistics and metadata of one text, all in 0 to 1."""
    text = text or ""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    shares = np.sqrt(np.bincount(class_of()[codes], minlength=len(CLASSES) + 1) / max(len(codes), 1))  # small shares stand apart
    words, lines = text.split(), text.split("\n")
    n = max(len(words), 1)
    return [scale(len(codes)), *shares.tolist(), scale(n_chars or 0), float(n_chars is None), float(n_chars is not None and n_chars != len(codes)),
            len(set(words)) / n, sum(map(eq, words, words[1:])) / n, min(1.0, len(codes) / n / 30), scale(len(words)), len(set(lines)) / len(lines), scale(len(lines))]


def statistics(docs: DataFrame) -> DataFrame:
    """``docs`` (text, n_chars and others) with the array ``stats``."""
    @F.pandas_udf("array<double>")
    def stats(text: pd.Series, n_chars: pd.Series) -> pd.Series:
        return pd.Series([text_statistics(t, None if pd.isna(n) else int(n)) for t, n in zip(text, n_chars)])

    use_small_batches(docs.sparkSession)
    return docs.withColumn("stats", stats("text", "n_chars"))


def features(docs: DataFrame, centre: list[float], spread: list[float]) -> DataFrame:
    """The output of ``statistics`` with the vector ``features`` in place of text and stats."""
    scaled = F.transform(F.arrays_zip("stats", F.array(*map(F.lit, centre)).alias("m"), F.array(*map(F.lit, spread)).alias("s")),
                         lambda x: F.greatest(F.lit(-CUT), F.least(F.lit(CUT), (x["stats"] - x["m"]) / x["s"])))
    words = F.array_remove(F.split(F.lower(F.coalesce(F.col("text"), F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    docs = docs.withColumn("__stats", array_to_vector(scaled)).withColumn("__words", words).drop("text", "stats")
    docs = HashingTF(inputCol="__words", outputCol="__tf", numFeatures=BUCKETS, binary=True).transform(docs).drop("__words")
    docs = Normalizer(inputCol="__tf", outputCol="__unit").transform(docs)
    docs = VectorAssembler(inputCols=["__stats", "__unit"], outputCol="__all").transform(docs)
    weights = Vectors.dense([1.0] * len(centre) + [WORD_WEIGHT] * BUCKETS)
    return ElementwiseProduct(inputCol="__all", outputCol="features", scalingVec=weights).transform(docs).drop("__stats", "__tf", "__unit", "__all")


def training_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, n_chars, label): the sample of labelled rows that are not held out."""
    marks = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
    marks = marks.where(~held_out(F.col("doc_id")))
    key = F.xxhash64("text", "n_chars").alias("h")
    ids = docs.select("doc_id", key).distinct().join(marks, "doc_id").groupBy("h").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    chosen = ids.where("low = high").orderBy("h").limit(SAMPLE).select("h", F.col("low").cast("double").alias("label"))
    # bounded by SAMPLE rows of 16 bytes; copies of a text are folded before they move
    texts = docs.select(key, "text", "n_chars").join(F.broadcast(checkpointed(chosen)), "h")
    return texts.groupBy("h").agg(F.min(F.struct("text", "n_chars")).alias("d"), F.min("label").alias("label")).select("d.text", "d.n_chars", "label")


class Machine:
    """A fitted machine with the scale of its statistics."""

    def __init__(self, model, centre: list[float], spread: list[float]):
        self.model, self.centre, self.spread = model, centre, spread

    def score(self, docs: DataFrame) -> DataFrame:
        rows = features(statistics(docs), self.centre, self.spread)
        return self.model.transform(rows).withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


class Constant:
    """The score where one label is all there is."""

    def __init__(self, value: float):
        self.value = value

    def score(self, docs: DataFrame) -> DataFrame:
        return docs.withColumn("score", F.lit(self.value))


def fit(docs: DataFrame, labels: DataFrame) -> Machine | Constant:
    """The machine fitted on the labelled rows that are not held out."""
    rows = checkpointed(statistics(training_texts(docs, labels)))
    seen = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(seen) < 2:
        return Constant((seen.get(1.0, 0) + 0.5) / (sum(seen.values()) + 1))
    moments = rows.select(F.posexplode("stats").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).orderBy("i").collect()
    centre, spread = [r["m"] for r in moments], [r["s"] if r["s"] > 1e-9 else 1.0 for r in moments]
    train = checkpointed(features(rows, centre, spread).select("features", "label").coalesce(4))
    machine = FMClassifier(factorSize=FACTORS, regParam=DECAY, maxIter=ROUNDS, stepSize=STEP, tol=0.0, solver="adamW", seed=11)
    return Machine(machine.fit(train), centre, spread)


def quality_scores(docs: DataFrame, labels: DataFrame, model: Machine | Constant | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs``; see the module."""
    n_chars = F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), n_chars.cast("long").alias("n_chars"))
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    out = (model or fit(docs, labels)).score(docs)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
