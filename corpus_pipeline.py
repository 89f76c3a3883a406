"""From raw documents to training shards, stage by stage.

Each stage takes ``(spark, docs, sf_dir)`` and returns a table, which is written and read
again as the next stage's documents. All but the last return the columns of ``documents``;
mixing repeats the rows that it draws twice, sharding adds ``shard`` and ``slot``.
"""

from __future__ import annotations

from collections.abc import Callable

from ebbtide.llm import decontaminate, mixing, sharding, simhash, toxicity
from ebbtide.llm.scratch import stored, table
from pyspark.sql import DataFrame, SparkSession

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go."""
    return toxicity.clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.deduplicated(docs, shingle=3, radius=3)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a copy of a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources draws them: never, once or twice."""
    return mixing.repeated(docs)


def in_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets a shard and a slot in it."""
    return sharding.sharded(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", without_toxic),
    ("near_copies", without_near_copies),
    ("decontamination", without_benchmark),
    ("mixing", mixed_sources),
    ("sharding", in_shards),
]

#: A trained model decides in the first stage and hashes that DuckDB lacks in others.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
