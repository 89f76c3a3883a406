"""The whole training job: encode, split, fit, evaluate, store, log."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ebbtide.operators import leafwise
from ebbtide.operators.attribution import read_trees, staged_scores
from ebbtide.operators.boosted import ChurnModel, fit, losses_by_round, save
from ebbtide.operators.clean import training_frame
from ebbtide.operators.evaluate import roc_auc
from ebbtide.operators.split import stratified_split
from ebbtide.schema import DataConfig, ModelConfig
from ebbtide.session import fresh_path, remove
from ebbtide.sources.files import first_rows, observed
from ebbtide.sources.ledger import record_run


@dataclass(frozen=True)
class TrainingResult:
    model: ChurnModel
    auc: float
    train_rows: int
    test_rows: int
    #: Rows of the table without a usable label; they take no part.
    unlabelled: int
    #: Mean log-loss on the test part after each tree.
    losses: tuple[float, ...]
    #: Area on the test part after so many trees.
    areas: dict[int, float]
    run_id: str | None = None


def some_rounds(trees: int, n: int = 10) -> list[int]:
    """About n evenly spaced rounds, the last one included."""
    return sorted({max(1, round(trees * i / n)) for i in range(1, n + 1)})


@dataclass(frozen=True)
class Prepared:
    """The encoded training table, split in two, with what was counted on the way."""

    sides: DataFrame
    columns: list[str]
    sizes: dict[bool, int]
    unlabelled: int
    scratch: list[str]


def prepared(
    spark: SparkSession,
    table: DataFrame,
    key: str,
    data: DataConfig,
    config: ModelConfig,
    max_rows: int | None,
) -> Prepared:
    """Encode and split a raw training table.

    All labelled rows are used, or the first ``max_rows`` of them by key. The raw table is
    read twice: for the vocabulary, and to write the encoded frame to the shared folder. The
    split's cut is found on two columns of that frame, and both sides are filters over it.
    """
    encoded, _ = training_frame(table, data, key)
    frame, seen = observed(encoded, "labelled")
    path = fresh_path(spark, "encoded")
    scratch = [path]
    frame.write.parquet(path)
    stored = spark.read.parquet(path)
    labelled = seen.get["rows"]
    unlabelled = table.count() - labelled
    if max_rows is not None and max_rows < labelled:
        kept_path = fresh_path(spark, "sample")
        scratch.append(kept_path)
        first_rows(stored, "key", max_rows).write.parquet(kept_path)
        stored = spark.read.parquet(kept_path)
    columns = [c for c in encoded.columns if c not in ("key", "Churn")]
    sides = stratified_split(stored, "Churn", "key", config.test_share, config.seed)
    sizes = dict(sides.groupBy("is_train").agg(F.count("*")).collect())
    return Prepared(sides, columns, sizes, unlabelled, scratch)


def _parameters(config: ModelConfig, max_rows: int | None, data: Prepared) -> dict[str, object]:
    return {**asdict(config), "max_rows": "all" if max_rows is None else max_rows,
            "rows": sum(data.sizes.values()), "columns": len(data.columns)}


def train_leafwise(
    spark: SparkSession,
    table: DataFrame,
    key: str = "key",
    data: DataConfig = DataConfig(),
    config: ModelConfig = ModelConfig(),
    model_path: str | None = None,
    ledger_path: str | None = None,
    max_rows: int | None = None,
) -> tuple[leafwise.LeafwiseModel, Prepared]:
    """Train leaf-wise trees as configured; the model has the held-out area of every round.

    The ledger has the last area as ``roc_auc`` and each round's as ``roc_auc_<round>``.
    """
    ready = prepared(spark, table, key, data, config, max_rows)
    rows = ready.sides.withColumn("_test", ~F.col("is_train")).drop("is_train")
    model = leafwise.fit(rows, ready.columns, "Churn", config, "_test")
    for written in ready.scratch:
        remove(spark, written)
    if model_path is not None:
        leafwise.save(model, model_path)
    if ledger_path is not None:
        areas = {f"roc_auc_{i}": a for i, a in enumerate(model.areas, 1) if a is not None}
        if model.areas and model.areas[-1] is not None:
            areas["roc_auc"] = model.areas[-1]
        record_run(spark, ledger_path, _parameters(config, max_rows, ready), areas,
                   model_path or "")
    return model, ready


def train(
    spark: SparkSession,
    table: DataFrame,
    key: str = "key",
    data: DataConfig = DataConfig(),
    config: ModelConfig = ModelConfig(),
    model_path: str | None = None,
    ledger_path: str | None = None,
    max_rows: int | None = None,
    rounds: Sequence[int] | None = None,
) -> TrainingResult:
    """Train on a raw training table.

    The table is encoded and split as :func:`prepared` says; the ledger has what was
    applied. ``rounds`` names the numbers of trees after which the area is taken; by default
    ten, as each repeats the test rows. :func:`train_leafwise` takes all of them.
    """
    ready = prepared(spark, table, key, data, config, max_rows)
    columns, sizes = ready.columns, ready.sizes
    train_rows = ready.sides.filter("is_train").drop("is_train")
    test_rows = ready.sides.filter("NOT is_train").drop("is_train")

    model = fit(train_rows, columns, "Churn", config)
    auc = roc_auc(model.score(test_rows), "Churn", "probability").head()["auc"]
    losses = losses_by_round(model, test_rows)
    staged = staged_scores(spark, read_trees(spark, model), columns, test_rows,
                           rounds or some_rounds(config.trees))
    areas = {r["round"]: r["auc"] for r in roc_auc(
        staged, "Churn", "probability", by=["round"]).collect()}
    for written in ready.scratch:
        remove(spark, written)
    run_id = None
    if model_path is not None:
        save(model, model_path)
    if ledger_path is not None:
        run_id = record_run(spark, ledger_path, _parameters(config, max_rows, ready),
                            {"roc_auc": auc}, model_path or "")
    return TrainingResult(model, auc, sizes.get(True, 0), sizes.get(False, 0), ready.unlabelled,
                          tuple(losses), areas, run_id)
