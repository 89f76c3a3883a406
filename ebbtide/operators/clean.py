"""Cleaning of a training table and its data-driven encoding."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F, types as T

from ebbtide.functions.numbers import NUMBER_PATTERN
from ebbtide.functions.plans import quoted, text
from ebbtide.operators.encode import sanitise_columns
from ebbtide.schema import DataConfig, one_hot_name

CHARGES_SPELLINGS = ("TotalCharges", "Total Charges")
SENIOR_SPELLINGS = ("SeniorCitizen", "Senior Citizen")
UNICODE_BLANK = r"(?U)^\s*$"


def drop_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drop those of ``names`` that are there."""
    return df.drop(*names)


def clean_charges(df: DataFrame) -> DataFrame:
    """Total charges for training: blank or missing text is 0.0, junk is an error; a
    column that is numeric already keeps its nulls."""
    name = next((n for n in CHARGES_SPELLINGS if n in df.columns), None)
    if name is None or not isinstance(df.schema[name].dataType, T.StringType):
        return df
    given = F.col(quoted(name))
    blank = given.isNull() | given.rlike(UNICODE_BLANK)
    problem = F.concat(F.lit(f"not a number in {name}: "), given)
    number = (
        F.when(blank, F.lit(0.0))
        .when(given.rlike(NUMBER_PATTERN), given.try_cast("double"))
        .otherwise(F.raise_error(problem).cast("double"))
    )
    return df.withColumn(name, number)


def senior_as_text(df: DataFrame) -> DataFrame:
    name = next((n for n in SENIOR_SPELLINGS if n in df.columns), None)
    return df if name is None else df.withColumn(name, F.col(quoted(name)).cast("string"))


def keep_binary_target(df: DataFrame, config: DataConfig) -> DataFrame:
    """Rows with a usable target, recoded to a 0/1 column called ``Churn``."""
    target = F.col(quoted(config.target))
    kept = df.filter(target.isin(config.positive, config.negative))
    if config.target != "Churn":
        positive = (target == F.lit(config.positive)).cast("tinyint")
        return kept.withColumn("Churn", positive).drop(config.target)
    return kept.withColumn("Churn", target.cast("tinyint"))


def clean(df: DataFrame, config: DataConfig = DataConfig()) -> DataFrame:
    """Drop, repair and filter; the row filter reaches the scan."""
    df = drop_columns(df, config.drop_columns)
    return keep_binary_target(senior_as_text(clean_charges(df)), config)


class VocabularyTooLarge(ValueError):
    """A text column has too many categories to become indicator columns."""


def vocabulary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct (column, value) pairs of the text columns, null included.

    One pass: the columns are unpivoted and the pairs pre-aggregated in each task, so
    only distinct pairs are shuffled, however often a value repeats.
    """
    pairs = ", ".join(f"{text(c)}, {quoted(c)}" for c in columns)
    unpivoted = df.selectExpr(f"stack({len(columns)}, {pairs}) AS (column, value)")
    return unpivoted.groupBy("column", "value").agg(F.count("*").alias("n"))


@dataclass(frozen=True)
class Dummies:
    """A learned vocabulary; values sorted, null last."""

    values: dict[str, tuple[str | None, ...]]

    @classmethod
    def fit(cls, df: DataFrame, max_values: int = 1000) -> Dummies:
        """Learn the categories of every text column in one job.

        The vocabulary becomes columns, so it has to be small: more than
        ``max_values`` categories in a column is an error, never a cut.
        """
        columns = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
        if not columns:
            return cls({})
        bound = max_values * len(columns)
        pairs = vocabulary(df, columns).select("column", "value").limit(bound + 1).collect()
        found: dict[str, list[str | None]] = {c: [] for c in columns}
        for column, value in pairs:
            found[column].append(value)
        large = [c for c, v in found.items() if len(v) > max_values]
        if large or len(pairs) > bound:
            raise VocabularyTooLarge(
                f"more than {max_values} categories in: {', '.join(large) or 'the text columns'}"
            )
        order = {c: tuple(sorted(v, key=lambda x: (x is None, x or ""))) for c, v in found.items()}
        return cls(order)

    def columns(self) -> list[str]:
        return [one_hot_name(c, v) for c, values in self.values.items() for v in values]

    def transform(self, df: DataFrame) -> DataFrame:
        """Replace each text column by its indicators, in place."""
        out = []
        for name in df.columns:
            ref = quoted(name)
            if name not in self.values:
                out.append(ref)
                continue
            for v in self.values[name]:
                test = f"{ref} IS NULL" if v is None else f"{ref} = {text(v)}"
                raw_name = quoted(f"{name}_{'null' if v is None else v}")
                out.append(f"coalesce(cast({test} AS int), 0) AS {raw_name}")
        return df.selectExpr(*out)


def training_frame(
    df: DataFrame, config: DataConfig = DataConfig(), key: str = "key", max_values: int = 1000
) -> tuple[DataFrame, Dummies]:
    """The training encoder: ``key``, learned feature columns, ``Churn``.

    Any column may be the key, also a text and one of those that no model may see, such as
    "Customer ID"; it is called ``key`` from here on.
    """
    if key != "key":
        df = df.drop("key").withColumnRenamed(key, "key")
    cleaned = clean(df, config)
    dummies = Dummies.fit(cleaned.drop("key"), max_values)
    encoded = dummies.transform(cleaned)
    features = [c for c in encoded.columns if c not in ("key", "Churn")]
    ordered = encoded.selectExpr(*map(quoted, ["key", *features, "Churn"]))
    return sanitise_columns(ordered), dummies


def same_columns(trained: DataFrame, scored: DataFrame, carry: Sequence[str]) -> bool:
    """Do both encoders produce the same set of feature columns?"""
    return set(trained.columns) - set(carry) == set(scored.columns) - set(carry)


def parity(trained: DataFrame, scored: DataFrame, key: str = "key") -> DataFrame:
    """Agreement of the two encoders: one row with the row count, both column counts and
    the number of rows that differ or that only one side has.

    Equal rows are counted together on both sides before anything is shuffled, and the
    counts compared: no join, and a key with many copies is one counted row.
    """
    left = [c for c in trained.columns if c not in (key, "Churn")]
    right = [c for c in scored.columns if c not in (key, "Churn")]
    shared = [c for c in left if c in right]
    row = F.struct(*[F.col(quoted(c)).cast("double").alias(c) for c in shared])

    def side(df: DataFrame, a: int, b: int) -> DataFrame:
        return df.select(F.col(quoted(key)).alias("key"), row.alias("row"),
                         F.lit(a).alias("a"), F.lit(b).alias("b"))

    both = side(trained, 1, 0).unionAll(side(scored, 0, 1)).groupBy("key", "row").agg(
        F.sum("a").alias("a"), F.sum("b").alias("b"))
    more = F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0)))
    less = F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0)))
    return both.agg(
        F.greatest(F.sum("a"), F.sum("b")).alias("rows"),
        F.lit(len(left)).alias("train_columns"),
        F.lit(len(right)).alias("score_columns"),
        F.lit(len(shared)).alias("shared_columns"),
        F.greatest(more, less).alias("rows_that_differ"),
    )
