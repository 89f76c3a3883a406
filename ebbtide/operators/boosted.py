"""The boosted-tree model: training, evaluation, storage and scoring."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from ebbtide.functions.plans import once
from ebbtide.operators.split import few_classes, with_class_weight
from ebbtide.schema import FEATURE_COLUMNS, ModelConfig

VECTOR = "features"
#: Rows of one task of a fit, unless there are fewer tasks than cores.
LEAST_ROWS, MOST_ROWS = 20_000, 250_000


class ModelNotFound(FileNotFoundError):
    """No model at the path: training has to run first."""


class ModelCorrupted(RuntimeError):
    """There is something at the path, but no model that gives probabilities."""


@dataclass(frozen=True)
class ChurnModel:
    """A fitted pipeline and the feature columns it expects."""

    pipeline: PipelineModel
    columns: tuple[str, ...]

    @property
    def trees(self) -> GBTClassificationModel:
        return self.pipeline.stages[-1]

    def score(self, frame: DataFrame) -> DataFrame:
        """Add ``logit``, the log-odds, and ``probability`` of churn to an aligned frame."""
        scored = self.pipeline.transform(frame)
        chance = vector_to_array(F.col("_chances"))[1]
        # The raw prediction is half the log-odds.
        logit = 2 * vector_to_array(F.col("_raw"))[1]
        return once(scored, {"logit": logit, "probability": chance}).drop(
            VECTOR, "_chances", "_raw", "_class")


def fit(
    train: DataFrame,
    columns: Sequence[str] = FEATURE_COLUMNS,
    label: str = "Churn",
    config: ModelConfig = ModelConfig(),
) -> ChurnModel:
    """Fit boosted trees on log-loss with balanced class weights.

    Trees grow level by level over binned features, one aggregation per level; the
    predictions so far are checkpointed so the lineage stays short over many trees. The
    input is dealt out once, since every one of the passes runs as wide as it is cut, and a
    pass reads what MLlib keeps of a row, some 800 bytes: so the rows of a task are bounded.
    """
    labelled = train.filter(F.col(label).isNotNull())
    counts = few_classes(labelled, label)
    weighted = with_class_weight(labelled, label, "_weight", counts).withColumn(
        label, F.col(label).cast("double")
    )
    assembler = VectorAssembler(inputCols=list(columns), outputCol=VECTOR)
    boosted = GBTClassifier(
        labelCol=label, featuresCol=VECTOR, weightCol="_weight", predictionCol="_class",
        maxIter=config.trees, maxDepth=config.depth, stepSize=config.step, seed=config.seed,
        lossType="logistic", maxMemoryInMB=512, checkpointInterval=10,
    ).setProbabilityCol("_chances").setRawPredictionCol("_raw")
    rows, cores = sum(counts.values()), train.sparkSession.sparkContext.defaultParallelism
    tasks = min(1 + rows // LEAST_ROWS, max(cores, 1 + rows // MOST_ROWS))
    needed = weighted.select(*columns, label, "_weight").repartition(tasks)
    return ChurnModel(Pipeline(stages=[assembler, boosted]).fit(needed), tuple(columns))


def losses_by_round(model: ChurnModel, frame: DataFrame, label: str = "Churn") -> list[float]:
    """Mean log-loss after each tree on a held-out frame, every row weighing the same;
    one number per tree."""
    labelled = frame.withColumns({label: F.col(label).cast("double"), "_weight": F.lit(1.0)})
    prepared = model.pipeline.stages[0].transform(labelled)
    return list(model.trees.evaluateEachIteration(prepared))


def save(model: ChurnModel, path: str) -> None:
    """Write the pipeline and, beside it, the feature columns it expects."""
    model.pipeline.write().overwrite().save(f"{path}/pipeline")
    spark = SparkSession.active()
    text = json.dumps(list(model.columns))
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(
        f"{path}/columns"
    )


def load(spark: SparkSession, path: str) -> ChurnModel:
    """Read a saved model, telling a missing one from a broken one."""
    try:
        spark.read.text(f"{path}/pipeline/metadata").head()
        found = True
    except AnalysisException:
        found = False
    if not found:
        raise ModelNotFound(f"no model at {path}; run the training job first")
    try:
        columns = tuple(json.loads(spark.read.text(f"{path}/columns").head()[0]))
        pipeline = PipelineModel.load(f"{path}/pipeline")
    except Exception as problem:
        raise ModelCorrupted(f"the model at {path} cannot be read: {problem}") from problem
    last = pipeline.stages[-1] if pipeline.stages else None
    if not isinstance(last, GBTClassificationModel):
        raise ModelCorrupted(f"the model at {path} does not end in a probability classifier")
    return ChurnModel(pipeline, columns)
