"""Tables written between steps, in the folder all executors share.

A written table cuts the lineage: a lost executor costs the tasks it ran, not the whole
history, and an expensive pass over the texts is not repeated.
"""

from __future__ import annotations

import os
from collections.abc import Iterable

import ebbtide
from ebbtide.session import fresh_path
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def reachable(spark: SparkSession) -> None:
    """Python workers look for this package where the driver has it. On a cluster whose
    machines do not, ship it with ``--py-files``."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(ebbtide.__file__)))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (known, root)))


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write the rows and read them back."""
    spark = df.sparkSession
    reachable(spark)
    path = fresh_path(spark, f"llm-{label}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files of a stored table that no later result reads."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(hadoop).delete(path, True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    reachable(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def narrow(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Only the named columns, so that no other column can clash with a computed one."""
    return df.select(*[df[c] for c in columns])


def mark(docs: DataFrame) -> Column:
    """With doc_id, tells rows apart where ids are null or repeated."""
    return F.xxhash64(docs["text"])


def keep_rows(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """The documents whose doc_id is (or, ``left_anti``, is not) among the ids.

    ``ids`` has a column ``doc_id`` and may have a column ``mark``, which then must match
    too. A null id equals a null id. No column is added.
    """
    wanted = ids.select(*[F.col(c).alias(f"__{c}") for c in ids.columns])
    same = docs["doc_id"].eqNullSafe(wanted["__doc_id"])
    if "mark" in ids.columns:
        same = same & (mark(docs) == wanted["__mark"])
    return docs.join(wanted, same, how)


def hash_share(column: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the value and the seed alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), column), 11) * F.lit(2.0**-53)
