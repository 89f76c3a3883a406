"""ROC AUC, exact, with ties averaged."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window, functions as F

from ebbtide.session import fresh_path

ROWS_PER_SLICE = 50_000


def _score_counts(df: DataFrame, label: str, score: str, by: Sequence[str]) -> DataFrame:
    """Positives and negatives per distinct score; ties collapse before the shuffle."""
    positive, number = F.col(label) == 1, F.col(score).cast("double")
    usable = F.col(label).isNotNull() & number.isNotNull() & ~F.isnan(number)
    # What is left out is counted under one score, apart from all others.
    return df.groupBy(*by, F.when(usable, number).alias("score")).agg(
        F.count_if(usable & positive).alias("pos"), F.count_if(usable & ~positive).alias("neg"),
        F.count_if(~usable).alias("out"),
    )


def _balanced_cuts(counts: DataFrame, slices: int) -> list[float]:
    """Score values that cut the distinct scores into slices of about equal size."""
    if slices == 1:
        return []
    shares = [i / slices for i in range(1, slices)]
    cuts = counts.approxQuantile("score", shares, 0.2 / slices)
    return [float("-inf"), *sorted(set(cuts)), float("inf")]


def roc_auc(
    df: DataFrame,
    label: str = "Churn",
    score: str = "probability",
    by: Sequence[str] = (),
    slices: int | None = None,
) -> DataFrame:
    """One row (per ``by`` group): ``positives``, ``negatives``, ``left_out``, ``auc``.

    A row without a label, or whose score is null or not a number, has no place in the
    order: it is counted in ``left_out`` and in nothing else.

    The area is the share of (positive, negative) pairs in order, ties half, counted
    from the negatives below each distinct score. The running count is taken inside
    slices of the score range and offset by the totals of the slices below, so no task
    sees all scores; the result does not depend on ``slices``. The counts are needed
    twice (to find the slices, then to count), so they are written to the shared folder
    and the scoring above them runs once; a slice then holds about ``ROWS_PER_SLICE``
    of them. ``slices=1`` skips that for a score with few distinct values.
    """
    counts = _score_counts(df, label, score, by)
    cuts: list[float] = []
    if slices != 1:
        path = fresh_path(df.sparkSession, "score-counts")
        counts.write.parquet(path)
        counts = df.sparkSession.read.schema(counts.schema).parquet(path)
        slices = slices or 1 + counts.count() // ROWS_PER_SLICE
        cuts = _balanced_cuts(counts, slices)
    if len(cuts) > 2:
        counts = Bucketizer(splits=cuts, inputCol="score", outputCol="slice",
                            handleInvalid="keep").transform(counts)
    else:
        counts = counts.withColumn("slice", F.lit(0.0))
    inside = Window.partitionBy(*by, "slice").orderBy("score")
    below = counts.withColumn("neg_below", F.sum("neg").over(inside) - F.col("neg"))
    # Twice the number of pairs in order, as whole numbers: exact however many rows.
    pairs = F.col("pos").cast("decimal(38,0)")
    per_slice = below.groupBy(*by, "slice").agg(
        F.sum("pos").alias("pos"),
        F.sum("neg").alias("neg"),
        F.sum("out").alias("out"),
        F.sum(pairs * (2 * F.col("neg_below") + F.col("neg")).cast("decimal(19,0)")).alias("twice"),
    )
    # One row per slice, a 50,000th of the distinct scores.
    lower = Window.partitionBy(*by).orderBy("slice")
    lifted = per_slice.withColumn("neg_lower", F.sum("neg").over(lower) - F.col("neg"))
    total = lifted.groupBy(*by).agg(
        F.sum("pos").alias("positives"),
        F.sum("neg").alias("negatives"),
        F.sum("out").alias("left_out"),
        F.sum(
            F.col("twice") + 2 * F.col("pos").cast("decimal(18,0)") * F.col("neg_lower").cast("decimal(18,0)")
        ).alias("twice"),
    )
    pairs_all = F.col("positives").cast("double") * F.col("negatives").cast("double")
    return total.select(
        *by, "positives", "negatives", "left_out",
        F.try_divide(F.col("twice").cast("double") / F.lit(2.0), pairs_all).alias("auc"),
    )
