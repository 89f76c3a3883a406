"""Stratified splitting and class weights."""

from __future__ import annotations

from collections.abc import Mapping
from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window, functions as F

from ebbtide.schema import ModelConfig

Label = int | str
MAX_CLASSES = 100


class TooManyClasses(ValueError):
    """The label looks like a measurement, not like a class."""


def class_counts(df: DataFrame, label: str = "Churn") -> DataFrame:
    return df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))


def class_weights(df: DataFrame, label: str = "Churn") -> DataFrame:
    """``label``, ``n`` and ``weight`` = rows / (classes * rows of the class), over the
    rows that have a label. :func:`class_counts` tells how many have none."""
    counts = class_counts(df, label).filter("label IS NOT NULL")
    rows = counts.agg(F.sum("n").cast("double")).scalar()
    classes = counts.agg(F.count("*")).scalar()
    return counts.withColumn("weight", rows / (classes * F.col("n")).cast("double"))


def few_classes(df: DataFrame, label: str = "Churn") -> dict[Label, int]:
    """Rows per class; a label with more than ``MAX_CLASSES`` values is refused."""
    counts = class_counts(df, label).filter("label IS NOT NULL")
    found = dict(counts.limit(MAX_CLASSES + 1).collect())
    if len(found) > MAX_CLASSES:
        raise TooManyClasses(f"{label} has more than {MAX_CLASSES} values")
    return found


def with_class_weight(df: DataFrame, label: str = "Churn", name: str = "weight",
                      counts: Mapping[Label, int] | None = None) -> DataFrame:
    """Add the balanced weight, null for a row without a label. The weights are at most
    ``MAX_CLASSES`` numbers and enter the plan as constants: no join. ``counts`` are those of
    :func:`few_classes`, if they are known."""
    counts = few_classes(df, label) if counts is None else counts
    total = sum(counts.values())
    weight = F.lit(None).cast("double")
    for value, n in counts.items():
        weight = F.when(F.col(label) == value, F.lit(total / (len(counts) * n))).otherwise(weight)
    return df.withColumn(name, weight)


def split_hash(key: Column, seed: int = ModelConfig.seed) -> Column:
    """A reproducible place in the line for every key."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")).cast("binary"))


def split_sizes(
    counts: Mapping[Label, int], test_share: float = ModelConfig.test_share
) -> dict[Label, int]:
    """Training rows per class: the test part is rounded up, and the training rows go to
    the classes in proportion, leftovers to the largest remainders."""
    total = sum(counts.values())
    n_train = total - ceil(total * test_share)
    exact = {label: n / total * n_train for label, n in counts.items()}
    sizes = {label: floor(x) for label, x in exact.items()}
    by_rest = sorted(exact, key=lambda label: (sizes[label] - exact[label], label))
    for label in by_rest[: n_train - sum(sizes.values())]:
        sizes[label] += 1
    return sizes


def split_thresholds(
    df: DataFrame,
    label: str = "Churn",
    key: str = "key",
    test_share: float = ModelConfig.test_share,
    seed: int = ModelConfig.seed,
) -> dict[Label, str]:
    """The last hash of each class that still belongs to the training part.

    Sorting a class would put it into one task. Instead the cut is found by counting:
    first over 65,536 hash prefixes per class, then over the hashes of the one prefix
    the cut falls into. A key with many copies is one counted row. Three light passes
    over two columns; one row per class comes back. A class too small for any training
    row has no threshold.
    """
    counts = few_classes(df, label)
    sizes = {c: n for c, n in split_sizes(counts, test_share).items() if n > 0}
    if not sizes:
        return {}
    wanted = F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair])

    hashed = split_hash(F.col(key), seed)
    lines = df.filter(F.col(label).isin(*sizes)).select(
        F.col(label).alias("label"), F.substr(hashed, F.lit(1), F.lit(4)).alias("prefix"),
        hashed.alias("hash"),
    )

    def at_the_cut(counted: DataFrame, by: str, target: Column) -> DataFrame:
        """The row of each class in which the running count reaches the target."""
        running = F.sum("n").over(Window.partitionBy("label").orderBy(by))
        totals = counted.withColumns({"upto": running, "target": target})
        return totals.filter("upto >= target AND upto - n < target")

    histogram = lines.groupBy("label", "prefix").agg(F.count("*").alias("n"))
    cut = at_the_cut(histogram, "prefix", F.element_at(wanted, F.col("label"))).selectExpr(
        "label", "prefix", "target - (upto - n) AS take"
    )
    # One row per class in `cut`.
    inside = (
        lines.join(F.broadcast(cut), ["label", "prefix"])
        .groupBy("label", "take", "hash").agg(F.count("*").alias("n"))
    )
    return dict(at_the_cut(inside, "hash", F.col("take")).select("label", "hash").collect())


def stratified_split(
    df: DataFrame,
    label: str = "Churn",
    key: str = "key",
    test_share: float = ModelConfig.test_share,
    seed: int = ModelConfig.seed,
) -> DataFrame:
    """Add ``is_train``: in each class, the first rows by the hash of their key.

    The thresholds are found right away; what is returned is a projection, so rows are
    neither shuffled nor joined. Copies of a key stay on one side.
    """
    side = F.lit(False)
    hashed = split_hash(F.col(key), seed)
    for value, last in split_thresholds(df, label, key, test_share, seed).items():
        side = F.when(F.col(label) == value, hashed <= last).otherwise(side)
    return df.withColumn("is_train", side)
