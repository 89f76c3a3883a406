"""Whole scoring jobs: record -> features -> probability -> score record."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ebbtide.functions.flags import blanks_to_null
from ebbtide.operators.attribution import PathTable, explain_trees
from ebbtide.operators.boosted import ChurnModel
from ebbtide.operators.encode import NULL_IS_MISSING, align, encode
from ebbtide.operators.explain import with_drivers, without_drivers
from ebbtide.operators.linear import LinearModel
from ebbtide.operators.score import append_batch_columns, classify
from ebbtide.operators.validate import MALFORMED, as_numbers, check_ranges, quarantine, require_rows
from ebbtide.schema import DEFAULT_TOP_K
from ebbtide.session import fresh_path, remove
from ebbtide.sources.files import observed, read_form_csv

RECORD = ("prediction", "churn_probability", "retention_risk", "feature_importance")


def feature_frame(
    df: DataFrame,
    columns: Sequence[str],
    carry: Sequence[str] = ("key",),
    null_means: str = NULL_IS_MISSING,
) -> DataFrame:
    return align(encode(df, carry, null_means), columns, carry)[0]


def score_linear(
    df: DataFrame,
    model: LinearModel = LinearModel(),
    carry: Sequence[str] = ("key",),
    null_means: str = NULL_IS_MISSING,
) -> DataFrame:
    """Score records of raw customers under the linear model, without drivers."""
    return classify(model.score(feature_frame(df, model.columns, carry, null_means)))


def explain_linear(
    df: DataFrame,
    model: LinearModel = LinearModel(),
    carry: Sequence[str] = ("key",),
    top_k: int = DEFAULT_TOP_K,
    style: str = "faithful",
    null_means: str = NULL_IS_MISSING,
) -> DataFrame:
    """As :func:`score_linear`, with contributions and drivers. With ``null_means`` a record
    is explained under the rule it is scored under, as single records are."""
    scored = model.explain(score_linear(df, model, carry, null_means))
    return with_drivers(scored, model.columns, top_k, style)


def append_scores(
    df: DataFrame, model: LinearModel | ChurnModel, null_means: str = NULL_IS_MISSING
) -> DataFrame:
    """The input columns as they came, with the rounded score and the 0/1 call."""
    given = df.withColumn("_input", F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    scored = model.score(feature_frame(given, model.columns, ("_input",), null_means))
    return append_batch_columns(scored.select("_input.*", "probability"))


def score_file(
    spark: SparkSession,
    source: str,
    scores: str,
    rejected: str,
    model: LinearModel | ChurnModel = LinearModel(),
    null_means: str = NULL_IS_MISSING,
) -> dict[str, int]:
    """A CSV of customers to a Parquet table of scores and one of rejected records.

    Records that break a rule go to ``rejected`` with the reasons and stop nothing; an
    empty file is an error. The checked records are written once and read for both sides.
    Returns the number of records read and of columns they have.
    """
    given, seen = observed(require_rows(read_form_csv(spark, source)), "file")
    checked = check_ranges(blanks_to_null(given))
    broken = F.when(F.col("malformed").isNotNull(), F.array(F.lit(MALFORMED)))
    path = fresh_path(spark, "checked")
    checked.withColumn("errors", F.coalesce(broken, "errors")).write.parquet(path)
    stored = spark.read.parquet(path)
    good = as_numbers(stored.filter(F.size("errors") == 0).drop("errors", "malformed"))
    append_scores(good, model, null_means).write.parquet(scores)
    quarantine(stored, "key", "malformed").write.parquet(rejected)
    remove(spark, path)
    return seen.get


def score_trees(
    df: DataFrame,
    model: ChurnModel,
    carry: Sequence[str] = ("key",),
    null_means: str = NULL_IS_MISSING,
) -> DataFrame:
    """Score records under a boosted model. Narrow from the scan to the sink."""
    return without_drivers(classify(
        model.score(feature_frame(df, model.columns, carry, null_means))
    ))


def explain_scored_trees(
    spark: SparkSession,
    df: DataFrame,
    model: ChurnModel,
    paths: PathTable,
    carry: Sequence[str] = ("key",),
    top_k: int = DEFAULT_TOP_K,
    null_means: str = NULL_IS_MISSING,
) -> DataFrame:
    """Score records with exact tree drivers for every row."""
    scored = classify(model.score(feature_frame(df, model.columns, carry, null_means)))
    return with_drivers(explain_trees(spark, paths, scored), paths.columns, top_k)


def records(scored: DataFrame, carry: Sequence[str] = ("key",)) -> DataFrame:
    return scored.select(*carry, *RECORD)
