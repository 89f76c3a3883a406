"""A ledger of training runs: one appended row per run."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

LEDGER_SCHEMA = (
    "experiment string, run_id string, started timestamp, params map<string,string>, "
    "metrics map<string,double>, artifact string"
)
DEFAULT_EXPERIMENT = "churn_prediction"


def record_run(
    spark: SparkSession,
    path: str,
    params: Mapping[str, object],
    metrics: Mapping[str, float],
    artifact: str,
    experiment: str = DEFAULT_EXPERIMENT,
) -> str:
    """Append a run and return its id."""
    run_id = uuid.uuid4().hex
    row = (
        experiment, run_id, datetime.now(timezone.utc),
        {k: str(v) for k, v in params.items()},
        {k: float(v) for k, v in metrics.items()}, artifact,
    )
    spark.createDataFrame([row], LEDGER_SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return run_id


def runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER_SCHEMA).parquet(path)
