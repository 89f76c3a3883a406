"""One-hot encoding of text columns of any width, as sparse rows.

``clean.Dummies`` makes a column of every value, so its vocabulary has to be small. Here the
vocabulary is a table that numbers the (column, value) pairs from 0 without gaps, and a row
carries the numbers of its values: as many as there are text columns, however many values
these have.

Null is a value of its own. A value that the vocabulary does not have sets no indicator, as in
the dense form. Repeated and null keys are rows like any other. No rows: an empty vocabulary.
"""

from __future__ import annotations

from collections.abc import Sequence

from ebbtide.operators.clean import vocabulary
from ebbtide.session import fresh_path
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

#: A value of more than 1 / FREQUENT of the rows is looked up in a broadcast table, which thus
#: has at most FREQUENT values a column; no other value has more rows than that.
FREQUENT = 2_000
MAX_BYTES = 64 << 20
#: Rows that need no lookup among the rarer values are spread over so many keys.
SPREAD = 1 << 20


class VectorTooWide(ValueError):
    """More indicators than a vector can have."""


def learn(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, value, n, number)``: every value of the columns, its rows and its number.

    The distinct pairs are written where the aggregation left them, each with its place in
    its partition; the partitions' sizes, one row each, turn places into numbers. Nothing is
    sorted.
    """
    spark = df.sparkSession
    path = fresh_path(spark, "vocabulary")
    placed = vocabulary(df, columns).withColumn("place", F.monotonically_increasing_id())
    placed.write.parquet(path)
    table = spark.read.schema(placed.schema).parquet(path)
    table = table.withColumn("part", F.shiftright("place", 33))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = table.groupBy("part").agg(F.count("*").alias("size"))
    starts = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    inside = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    return table.join(F.broadcast(starts), "part").select(
        "column", "value", "n", (F.col("start") + inside).alias("number"))


def _lookup(words: DataFrame, column: str, i: int) -> DataFrame:
    return words.where(F.col("column") == column).select(
        F.col("value").alias(f"__value{i}"), F.col("number").alias(f"__number{i}"))


def encode(df: DataFrame, words: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """Replace the columns by ``indices``: the numbers of a row's values in ascending order.

    Frequent values are found without moving a row. Only a column that has rarer ones costs
    a shuffle, in which no value has more than 1 / ``FREQUENT`` of the rows and rows that are
    already done are spread by ``key``.
    """
    total = words.where(F.col("column") == columns[0]).agg(F.sum("n")).first()[0] or 0
    is_frequent = F.col("n") * FREQUENT > total
    frequent, rare = words.where(is_frequent), words.where(~is_frequent)
    size = frequent.agg(F.sum(F.coalesce(F.octet_length("value"), F.lit(0)) + 64)).first()[0] or 0
    with_rare = {r["column"] for r in rare.groupBy("column").count().collect()}
    kept = [c for c in df.columns if c not in columns]
    numbers = []
    for i, name in enumerate(columns):
        found = _lookup(frequent, name, i)
        small = F.broadcast(found) if size <= MAX_BYTES else found
        df = df.join(small, F.col(f"`{name}`").eqNullSafe(F.col(f"__value{i}")), "left")
        number = F.col(f"__number{i}")
        if name in with_rare:
            j = i + len(columns)
            others = _lookup(rare, name, j).withColumn("__open", F.lit(0))
            done = F.lit(1) + F.pmod(F.xxhash64(f"`{key}`"), F.lit(SPREAD))
            df = df.withColumn(f"__at{i}", F.when(number.isNull(), F.lit(0)).otherwise(done))
            df = df.join(others, F.col(f"`{name}`").eqNullSafe(F.col(f"__value{j}"))
                         & (F.col(f"__at{i}") == F.col("__open")), "left").drop("__open")
            number = F.coalesce(number, F.col(f"__number{j}"))
        numbers.append(number)
    return df.select(*[F.col(f"`{c}`") for c in kept],
                     F.array_sort(F.array_compact(F.array(*numbers))).alias("indices"))


def as_vector(indices: Column, width: int) -> Column:
    """The indicators as an MLlib sparse vector, for its estimators."""
    if width >= 1 << 31:
        raise VectorTooWide(f"{width} indicators; a vector has fewer than 2 ** 31")
    ones = F.transform(indices, lambda _: F.lit(1.0))
    parts = F.struct(F.lit(0).alias("type"), F.lit(width).alias("size"),
                     indices.cast("array<int>").alias("indices"), ones.alias("values"))
    schema = T.StructType([T.StructField("v", VectorUDT())])
    return F.from_json(F.to_json(F.struct(parts.alias("v"))), schema)["v"]
