"""One stored chain from raw rows to predictions (MDL-21, SNK-02, SNK-04, PRJ-09, JN-06) and a
store for result tables (SNK-03, SNK-05).

A ``Predictor`` holds the clean ops with their recorded decisions, the fitted preprocessing
state, the spark.ml pipeline, the classes and the input schema. ``predict`` replays them as
column expressions over the raw rows, one output row per input row, so the same call scores
a table and a stream. ``save`` writes the model and a manifest into a folder of their own
and renames it into place, so a half-written model is never found; ``load`` refuses a model
of another Spark version or format.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field, fields

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import is_numeric_type, q
from . import metrics as M
from .clean import ROW_STEPS, apply_clean
from .models import class_codes, estimator
from .prep import fit_prep, transform
from .rows import input_schema, page

FORMAT = 1
UNKNOWN = "a class the model never saw - not scored"
NO_NUMBER = "no number - not scored"


@dataclass
class Predictor:
    target: str
    features: list[str]  # columns of the cleaned table
    inputs: list[str]  # numeric columns they become
    task: str
    clean_ops: list[dict]
    state: dict
    classes: list[str]
    schema: list[dict] = field(default_factory=list)
    model: PipelineModel | None = None

    # ---- fit ------------------------------------------------------------------
    @classmethod
    def fit(cls, raw: DataFrame, target: str, features: list[str], model: str, task: str = "classification", clean_ops: list[dict] | tuple = (),
            plan: dict | None = None, key: str | None = None, params: dict | None = None) -> Predictor:
        """Clean, learn the plan and fit on ``raw``, the training rows; rows without a usable target or
        with a gap left in a feature teach the model nothing."""
        table, ops = apply_clean(raw, list(clean_ops))
        for c in [target, *features]:
            if c not in table.columns:
                raise ValueError(f"no column {c} after cleaning")
        schema = [r.asDict() for r in input_schema(table, features).collect()]
        state = fit_prep(table, plan or {}, key)
        y = q(target).cast("double") if task == "regression" else q(target).cast("string")
        ready = transform(state, table.select(*[q(c) for c in features], y.alias("__y")))
        inputs = [c for c in ready.columns if c != "__y"]
        for c in inputs:
            if not is_numeric_type(ready.schema[c].dataType):
                raise ValueError(f"{c} is {ready.schema[c].dataType.simpleString()}: the plan must encode it")
        classes = []
        ready = ready.dropna()
        if task == "classification":
            codes = class_codes(ready, "__y")
            classes = [r["value"] for r in codes.orderBy("label").collect()]  # one per class, part of the model
            ready = ready.withColumn("label", (F.array_position(F.array(*map(F.lit, classes)), q("__y")) - 1).cast("double"))
        else:
            ready = ready.withColumnRenamed("__y", "label")
        stages = [VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep"), estimator(model, task, len(inputs), len(classes), params)]
        fitted = Pipeline(stages=stages).fit(ready.select("label", *[q(c).cast("double").alias(c) for c in inputs]))
        return cls(target, list(features), inputs, task, ops, state, classes, schema, fitted)

    # ---- predict --------------------------------------------------------------
    def predict(self, raw: DataFrame) -> DataFrame:
        """Every row of ``raw`` as it is, with prediction, for classification ``probability <class>`` (6
        digits), and, where the target is there, ``scored`` and ``note``. A row with a gap that the
        plan does not fill has null predictions. Row ops are not replayed."""
        whole = F.struct(*[q(c) for c in raw.columns]).alias("__raw")
        ops = [op for op in self.clean_ops if op["op"] not in ROW_STEPS]
        table, _ = apply_clean(raw.select(whole, "*"), ops, replay=True)
        missing = [c for c in self.features if c not in table.columns]
        if missing:
            raise ValueError(f"missing columns: {', '.join(missing)}")
        known = q(self.target).cast("string") if self.target in table.columns else None
        table = table.select("__raw", *([known.alias("__target")] if known is not None else []), *[q(c) for c in self.features])
        ready = transform(self.state, table)
        gap = F.lit(False)
        for c in self.inputs:
            gap = gap | q(c).isNull() | F.isnan(q(c).cast("double"))
        ready = ready.withColumn("__gap", gap).withColumns({c: F.coalesce(q(c).cast("double"), F.lit(float("nan"))) for c in self.inputs})
        out = self.model.transform(ready)
        shown = lambda c: F.when(~F.col("__gap"), c)
        cols = [F.col("__raw.*")]
        if self.task == "classification":
            cols.append(shown(F.element_at(F.array(*map(F.lit, self.classes)), F.col("prediction").cast("int") + 1)).alias("prediction"))
            if "probability" in out.columns:
                cols += [shown(F.round(vector_to_array("probability")[i], 6)).alias(f"probability {c}") for i, c in enumerate(self.classes)]
        else:
            cols.append(shown(F.col("prediction")).alias("prediction"))
        if known is not None:
            there = F.col("__target").isNotNull() & (F.trim("__target") != "")
            if self.task == "classification":
                usable, why = F.col("__target").isin(self.classes), UNKNOWN
            else:
                usable, why = F.col("__target").try_cast("double").isNotNull(), NO_NUMBER
            cols += [(there & usable & ~F.col("__gap")).alias("scored"), F.when(there & ~usable, F.lit(why)).alias("note"), F.when(there & usable, F.col("__target")).alias("actual")]
        return out.select(*cols)

    def score(self, predicted: DataFrame) -> dict:
        """The metrics over the scored rows of ``predict``."""
        rows = predicted.where("scored")
        if self.task == "classification":
            return M.classification_metrics(rows, "actual", "prediction").first().asDict()
        return M.regression_metrics(rows.withColumn("actual", F.col("actual").cast("double")), "actual", "prediction", len(self.inputs)).first().asDict()

    def test_rows(self, predicted: DataFrame, order: list[str], mistakes_only: bool = False, offset: int = 0, limit: int = 50) -> DataFrame:
        """PRJ-09 / JN-06: a page of scored rows: actual, prediction, correct and confidence (the largest
        probability), or the error for regression; ``mistakes_only`` leaves the wrong ones."""
        rows = predicted.where("scored")
        if self.task == "classification":
            chances = [c for c in predicted.columns if c.startswith("probability ")]
            rows = rows.withColumn("correct", F.col("actual") == F.col("prediction"))
            rows = rows.withColumn("confidence", F.greatest(*map(q, chances)) if len(chances) > 1 else F.lit(None).cast("double"))
            if mistakes_only:
                rows = rows.where(~F.col("correct"))
            shown = ["actual", "prediction", "correct", "confidence"]
        else:
            rows, shown = rows.withColumn("error", F.col("prediction") - F.col("actual").cast("double")), ["actual", "prediction", "error"]
        return page(rows, order, offset, limit).select(*[q(c) for c in order], *shown)

    # ---- save and load --------------------------------------------------------
    def save(self, spark: SparkSession, path: str) -> None:
        """Write to ``path``, which must not exist; it appears whole or not at all."""
        part = f"{path.rstrip('/')}.{uuid.uuid4().hex}.part"
        self.model.write().save(f"{part}/model")
        rest = {f.name: getattr(self, f.name) for f in fields(self) if f.name != "model"}
        manifest = json.dumps({"format": FORMAT, "spark_version": spark.version, "predictor": rest}, default=str)
        spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.text(f"{part}/manifest")
        fs, old, new = _paths(spark, part, path)
        if fs.exists(new) or not fs.rename(old, new):
            fs.delete(old, True)
            raise ValueError(f"{path} exists already")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Predictor:
        doc = json.loads(spark.read.text(f"{path.rstrip('/')}/manifest").first()[0])
        for name, now in (("format", FORMAT), ("spark_version", spark.version)):
            if doc.get(name) != now:
                raise ValueError(f"the model's {name} is {doc.get(name)}, here it is {now}")
        out = cls(**doc["predictor"])
        out.model = PipelineModel.load(f"{path.rstrip('/')}/model")
        return out


def _paths(spark: SparkSession, *names: str):
    """The Hadoop file system of the first path, and the paths."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    paths = [path(n) for n in names]
    return paths[0].getFileSystem(spark._jsc.hadoopConfiguration()), *paths


class ResultStore:
    """Result tables by run (SNK-03, SNK-05): one folder per table, one partition per run. Writing a
    run's table again replaces it; lists are joined by ``; ``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def put(self, run: str, table: str, df: DataFrame) -> None:
        from ..sources.files import report_table
        report_table(df).write.mode("overwrite").parquet(f"{self.folder}/{table}/run={run}")

    def get(self, table: str) -> DataFrame:
        """The table of all runs with the column ``run``."""
        return self.spark.read.option("mergeSchema", "true").parquet(f"{self.folder}/{table}")


def write_assignments(assigned: DataFrame, path: str, fmt: str = "parquet") -> None:
    """SNK-03: clustered rows with ``cluster``, -1 for noise; a row without a cluster is refused."""
    if assigned.where(F.col("cluster").isNull()).limit(1).count():
        raise ValueError("rows without a cluster: fill or drop rows with gaps first")
    (assigned.write.mode("overwrite").option("header", True).csv(path) if fmt == "csv" else assigned.write.mode("overwrite").parquet(path))
