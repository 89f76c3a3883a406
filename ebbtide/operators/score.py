"""From probabilities to score records, and their summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ebbtide.functions.numbers import round_half_even, round_scaled
from ebbtide.schema import HIGH_FROM, MEDIUM_FROM, ModelConfig


def prediction(p: Column, threshold: float = ModelConfig.threshold) -> Column:
    return (p >= threshold).cast("int")


def tier(p: Column) -> Column:
    """High, Medium or Low, decided on the unrounded probability."""
    return F.when(p >= HIGH_FROM, "High").when(p >= MEDIUM_FROM, "Medium").otherwise("Low")


def classify(df: DataFrame, p: str = "probability") -> DataFrame:
    """Add the score record's ``prediction``, ``churn_probability``, ``retention_risk``."""
    c = F.col(p)
    return df.withColumns({
        "prediction": prediction(c),
        "churn_probability": round_half_even(c, 4),
        "retention_risk": tier(c),
    })


def append_batch_columns(df: DataFrame, p: str = "probability") -> DataFrame:
    """The file-scoring output: input columns, the rounded score, the 0/1 call."""
    c = F.col(p)
    return df.withColumns({
        "churn_probability": round_scaled(c, 4), "prediction": prediction(c),
    }).drop(p)


def summary(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """How many records, how many of them High."""
    return scored.groupBy(*by).agg(
        F.count("*").alias("total_records"),
        F.count_if(F.col("retention_risk") == "High").alias("high_risk_count"),
    )
