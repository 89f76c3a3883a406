"""Timed runs at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The wide jobs run over one generated customer per line item, so their work grows with
the tables. Sinks are ``noop``: every column of every row is computed and dropped.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ebbtide import session  # noqa: E402
from ebbtide.operators import attribution, encode, evaluate, explain, validate  # noqa: E402
from ebbtide.operators.boosted import fit  # noqa: E402
from ebbtide.operators.linear import LinearModel  # noqa: E402
from ebbtide.plans import scoring  # noqa: E402
from ebbtide.plans.catalog import QUERIES  # noqa: E402
from ebbtide.schema import FIELD_NAMES, ModelConfig  # noqa: E402
from ebbtide.sources import files, generator  # noqa: E402
from pyspark.sql import DataFrame, SparkSession, functions as F  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
FIT_ROWS = 50_000
NAMED = (
    "telco_view", "encode_51", "validate_quarantine", "score_linear", "tier_summary",
    "drivers_top8", "precautions", "brief_text", "importance", "train_frame", "split_sides",
    "auc_exact", "rate_breach", "log_summary",
    # 300 leaf-wise trees as configured, with the area of every round: minutes.
    "boosted_rounds",
)


def drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def wide_customers(spark: SparkSession) -> DataFrame:
    """Generated customers on disk, one per line item, in a few dozen files."""
    lines = spark.read.parquet(f"{FOLDER}/lineitem.parquet")
    key = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1000 + F.col("l_partkey") % 1000
    path = session.fresh_path(spark, "bench-customers")
    made = generator.with_planted_churn(generator.customers_for(lines.select(key.alias("key"))))
    made.repartition(32).write.parquet(path)
    return spark.read.parquet(path)


def main() -> None:
    spark = session.build(
        "bench", f"local[{CPUS}]",
        **{"spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": "16g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}

    def timed(name, run):
        start = time.perf_counter()
        result = run()
        times[name] = round(time.perf_counter() - start, 3)
        return result

    wide = wide_customers(spark)
    rows = wide.count()
    linear = LinearModel()

    timed("wide_encode", lambda: drain(encode.features(wide)))
    raw = wide.select("key", F.to_json(F.struct(*FIELD_NAMES)).alias("raw"))
    timed("wide_validate", lambda: drain(
        validate.valid_records(validate.check_records(raw), "key")))
    timed("wide_score_linear", lambda: drain(scoring.score_linear(wide, linear)))
    timed("wide_explain_linear", lambda: drain(
        scoring.records(scoring.explain_linear(wide, linear))))
    timed("wide_auc", lambda: evaluate.roc_auc(
        scoring.score_linear(wide, linear, ("key", "Churn"))).collect())

    # Fits are bounded to 50,000 labelled rows; scoring and explaining run over all.
    train = files.first_rows(wide.dropDuplicates(["key"]), "key", FIT_ROWS)
    path = session.fresh_path(spark, "bench-train")
    train.write.parquet(path)
    sample = spark.read.parquet(path)
    path = session.fresh_path(spark, "bench-encoded")
    encode.features(sample, ("key", "Churn")).write.parquet(path)
    train = spark.read.parquet(path)
    model = timed("train_20_trees", lambda: fit(train, config=ModelConfig(trees=20)))
    timed("wide_score_trees", lambda: drain(scoring.score_trees(wide, model)))
    paths = attribution.path_table(attribution.read_trees(spark, model), model.columns)
    explained = scoring.explain_scored_trees(spark, wide, model, paths)
    timed("wide_explain_trees", lambda: drain(scoring.records(explained)))
    audit = explain.additivity_audit(explained).collect()[0]

    # The configured size, 300 trees, on and over the training rows: minutes, so on request.
    if os.environ.get("BENCH_FULL"):
        full = timed("train_300_trees", lambda: fit(train))
        trees = attribution.read_trees(spark, full)
        full_paths = timed("path_table_300_trees", lambda: attribution.path_table(trees, full.columns))
        timed("explain_300_trees", lambda: drain(scoring.records(
            scoring.explain_scored_trees(spark, sample, full, full_paths))))

    for name in NAMED:
        timed(name, lambda name=name: drain(QUERIES[name](spark, FOLDER)))

    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
        "wide_rows": rows, "max_residual": audit["worst"],
        "rows_per_sec": {
            n: round(rows / times[n]) for n in times if n.startswith("wide_") and times[n] > 0
        },
    }))


if __name__ == "__main__":
    main()
