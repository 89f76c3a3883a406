"""Customer tables in and out of files."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from ebbtide.functions.plans import quoted
from ebbtide.schema import RECORD_SCHEMA

#: Sampled keys among the rows that are looked for.
SAMPLED = 200
CSV_OPTIONS = {"header": True, "mode": "FAILFAST", "escape": '"'}


def keyed_schema(key: str = "key") -> T.StructType:
    return T.StructType([T.StructField(key, T.LongType()), *RECORD_SCHEMA.fields])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A CSV with a header. Without a schema the types are inferred, which reads the
    file twice; give the schema for anything large."""
    reader = spark.read.options(**CSV_OPTIONS)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def read_form_csv(spark: SparkSession, path: str, key: str = "key") -> DataFrame:
    """Customer records to be scored, every field as text: nothing a cell holds can end the
    job. ``malformed`` has the line where it has too few or too many cells or no key."""
    schema = T.StructType([
        T.StructField(key, T.LongType()),
        *[T.StructField(f.name, T.StringType()) for f in RECORD_SCHEMA.fields],
        T.StructField("malformed", T.StringType()),
    ])
    return spark.read.schema(schema).options(
        header=True, mode="PERMISSIVE", escape='"', columnNameOfCorruptRecord="malformed",
        enforceSchema=True,
    ).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Values as they are, blanks at either end included."""
    df.write.mode("overwrite").options(
        header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)


def read_json(spark: SparkSession, path: str, key: str = "key") -> DataFrame:
    """Customer records, one JSON object per line. Each file may also hold one array
    of objects; Spark then makes a row of each element."""
    return spark.read.schema(keyed_schema(key)).json(path)


def read_json_documents(spark: SparkSession, path: str, key: str = "key") -> DataFrame:
    """As :func:`read_json` for files whose JSON is spread over several lines. Such a
    file is read by one task, so keep them small."""
    return spark.read.schema(keyed_schema(key)).option("multiLine", True).json(path)


def read_json_text(spark: SparkSession, path: str, raw: str = "raw") -> DataFrame:
    """One unparsed record per line, for strict validation."""
    return spark.read.text(path).withColumnRenamed("value", raw)


def first_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows with the smallest keys of any ordered type; rows without a key come last.

    Sorting down to n would make every task hand n rows to a single one. A random sample of
    about ``SAMPLED`` keys among the n smallest gives a bound that more than n rows lie
    under, but not many more. Whether they do is counted, and if not the bound is raised.
    The bound only saves work: what is returned does not depend on it.
    """
    at = F.col(quoted(key))
    keyed = df.filter(at.isNotNull())
    kept, share = df, 1.3
    while n > 0:
        rate = SAMPLED / n
        reach = ceil(share * SAMPLED) + 1
        if rate >= 1:
            break
        lowest = keyed.select(at.alias("k")).sample(rate, seed=1).orderBy("k").limit(reach).collect()
        if len(lowest) < reach:
            break
        kept = keyed.filter(at <= F.lit(lowest[-1]["k"]))
        if kept.count() >= n:
            break
        kept, share = df, 2 * share
    return kept.orderBy(at.asc_nulls_last()).limit(n)


def observed(df: DataFrame, name: str = "shape") -> tuple[DataFrame, Observation]:
    """The frame with an observer that reports its ``rows`` and ``columns`` once an
    action has run over it; the counting rides along and needs no pass of its own."""
    seen = Observation(name)
    rows = F.count(F.lit(1)).alias("rows")
    return df.observe(seen, rows, F.max(F.lit(len(df.columns))).alias("columns")), seen


def load_training_csv(
    spark: SparkSession,
    path: str,
    key: str,
    schema: T.StructType | None = None,
    max_rows: int | None = None,
) -> DataFrame:
    """A training CSV: all rows, or on request the first ``max_rows`` by key."""
    table = read_csv(spark, path, schema)
    return table if max_rows is None else first_rows(table, key, max_rows)


def write_scores_json(scored: DataFrame, path: str, key: str = "key") -> None:
    """One nested score record per line; fields without a value are written as null."""
    scored.select(
        key, "prediction", "churn_probability", "retention_risk", "feature_importance"
    ).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def score_json(scored: DataFrame, key: str = "key") -> DataFrame:
    """The same record as a JSON text column."""
    record = F.struct("prediction", "churn_probability", "retention_risk", "feature_importance")
    return scored.select(key, F.to_json(record, {"ignoreNullFields": "false"}).alias("json"))
