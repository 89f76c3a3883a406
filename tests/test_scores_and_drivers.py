import math

import pytest
from pyspark.sql import functions as F

from ebbtide.operators import explain, panel, score
from ebbtide.operators.linear import LinearModel
from ebbtide.plans import scoring
from ebbtide.schema import DRIVER_TYPE
from ebbtide.sources import generator, profiles


@pytest.mark.parametrize("p, call, shown, tier", [
    (0.85, 1, 0.85, "High"), (0.55, 1, 0.55, "Medium"), (0.20, 0, 0.2, "Low"),
    (0.70, 1, 0.7, "High"), (0.40, 0, 0.4, "Medium"), (0.39, 0, 0.39, "Low"),
    (0.123456, 0, 0.1235, "Low"), (0.0, 0, 0.0, "Low"), (1.0, 1, 1.0, "High"),
    (0.69999, 1, 0.7, "Medium"),
])
def test_classify(spark, p, call, shown, tier):
    row = score.classify(spark.createDataFrame([(p,)], "probability double")).first()
    assert (row.prediction, row.churn_probability, row.retention_risk) == (call, shown, tier)


def test_summary(spark):
    df = spark.createDataFrame([("High",), ("Low",), ("High",)], "retention_risk string")
    assert tuple(score.summary(df).first()) == (3, 2)


def test_file_scores_keep_the_input(records):
    df = records({}, {"tenure": 70})
    got = scoring.append_scores(df, LinearModel())
    assert got.columns == [*df.columns, "churn_probability", "prediction"]
    assert got.select(df.columns).exceptAll(df).isEmpty()


COLUMNS = ("Tenure_in_Months", "Monthly_Charge", "Contract_Month_to_Month", "Gender_Male")


def drivers(spark, phi, values=(12.0, 70.5, 1.0, 0.0), top_k=8):
    df = spark.createDataFrame([(phi, list(values))], "phi array<double>, feature_values array<double>")
    got = explain.with_drivers(df, COLUMNS, top_k).first().feature_importance
    return got if got is None else [tuple(d) for d in got]


def test_drivers_are_ranked_by_size(spark):
    assert drivers(spark, [0.1, -0.5, 0.3, 0.0]) == [
        ("MonthlyCharges", 70.5, 0.5, "down"), ("Contract: Month-to-Month", 1.0, 0.3, "up"),
        ("tenure", 12.0, 0.1, "up"), ("Gender: Male", 0.0, 0.0, "up")]


def test_bias_is_cut_and_other_widths_are_null(spark):
    assert drivers(spark, [0.1, -0.5, 0.3, 0.0, 99.0]) == drivers(spark, [0.1, -0.5, 0.3, 0.0])
    assert drivers(spark, [0.1, -0.5]) is None
    assert drivers(spark, [0.1] * 6) is None
    assert drivers(spark, None) is None


def test_top_k(spark):
    assert len(drivers(spark, [0.1, -0.5, 0.3, 0.0], top_k=2)) == 2
    assert len(drivers(spark, [0.1, -0.5, 0.3, 0.0], top_k=99)) == 4
    assert drivers(spark, [0.1, -0.5, 0.3, 0.0], top_k=0) is None


def test_ties_keep_column_order(spark):
    assert [d[0] for d in drivers(spark, [0.2, -0.2, 0.2, 0.3])] == [
        "Gender: Male", "tenure", "MonthlyCharges", "Contract: Month-to-Month"]


def test_entries_that_are_no_numbers(spark):
    got = drivers(spark, [float("inf"), float("nan"), float("-inf"), -0.25], (1.0, float("nan"), None, 2.0))
    assert got == [("Gender: Male", 2.0, 0.25, "down"), ("tenure", 1.0, 0.0, "up"),
                   ("MonthlyCharges", None, 0.0, "up"), ("Contract: Month-to-Month", None, 0.0, "up")]


def test_contributions_add_up_on_generated_customers(spark):
    explained = scoring.explain_linear(generator.generated(spark, 2000), LinearModel())
    assert tuple(explain.additivity_audit(explained).select("rows", "additive").first()) == (2000, True)


def test_audit_catches_a_wrong_contribution(spark):
    explained = scoring.explain_linear(generator.generated(spark, 50), LinearModel())
    broken = explained.withColumn("phi", F.when(F.col("key") == 7, F.transform(
        "phi", lambda x: x + 0.001)).otherwise(F.col("phi")))
    assert not explain.additivity_audit(broken).first().additive


def test_a_filter_on_the_score_does_not_compute_it_again(spark):
    scored = scoring.score_linear(generator.generated(spark, 10), LinearModel())
    plan = scored.filter("retention_risk = 'High'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Contract_Month_to_Month#") < 12
    assert "Generate inline" in plan


def test_profiles(spark):
    both = {r.profile: r for r in profiles.profiles(spark).collect()}
    assert both["highRisk"].CLTV is None and both["loyal"].CLTV is None
    assert both["highRisk"].Under30 == 1 and both["loyal"].Contract == "Two Year"
    scored = scoring.score_linear(profiles.profiles(spark), LinearModel(), carry=("profile",))
    p = {r.profile: r.churn_probability for r in scored.collect()}
    assert p["loyal"] < 0.4 < p["highRisk"]
    with pytest.raises(ValueError):
        profiles.profile(spark, "nobody")


def test_baseline(spark):
    scored = spark.createDataFrame([(1, 0.62), (2, 0.05), (3, 0.1)], "key long, churn_probability double")
    baseline = spark.createDataFrame([(0.1,)], "churn_probability double")
    rows = panel.with_baseline(scored, baseline).orderBy("key").collect()
    assert [(r.delta_sign, r.delta_text, r.baseline_text) for r in rows] == [
        ("up", "+52.00 pts", "10.00%"), ("down", "-5.00 pts", "10.00%"), ("flat", "0.00 pts", "10.00%")]
    none = panel.with_baseline(scored, spark.createDataFrame([(0.0,)], "churn_probability double"))
    assert {r.delta for r in none.collect()} == {None}
    plan = none._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


@pytest.mark.parametrize("p, angle, colour", [
    (-1.0, 180.0, "#22c55e"), (0.0, 180.0, "#22c55e"), (0.33, 120.6, "#22c55e"),
    (0.34, 118.8, "#f59e0b"), (0.5, 90.0, "#f59e0b"), (0.66, 61.2, "#f59e0b"),
    (0.67, 59.4, "#ef4444"), (1.0, 0.0, "#ef4444"), (2.0, 0.0, "#ef4444"),
])
def test_gauge(spark, p, angle, colour):
    df = spark.createDataFrame([(p,)], "p double")
    row = df.select(panel.gauge_angle(F.col("p")), panel.gauge_colour(F.col("p"))).first()
    assert math.isclose(row[0], angle) and row[1] == colour


def test_bars(spark):
    features = [("a", 1.0, 0.2, "up"), ("b", 2.345, 0.4, "down"), ("c", None, 0.0, "up")]
    kind = f"array<{DRIVER_TYPE.simpleString()}>"
    df = spark.createDataFrame([(features,), ([("z", 0.0, 0.0, "up")],)], f"f {kind}")
    got = [[tuple(b) for b in r[0]] for r in df.select(panel.bars(F.col("f"))).collect()]
    assert got[0] == [("b", "2.35", "0.400", 50.0, 0.0), ("a", "1", "0.200", 25.0, 50.0),
                      ("c", "—", "0.000", 0.0, 50.0)]
    assert got[1] == [("z", "0", "0.000", 0.0, 50.0)]


def test_audit_by_margin_counts_what_it_cannot_audit(spark):
    rows = [(1, [2.0, 3.0], 0.5, 5.5, 1.0), (2, [40.0, 3.0], 0.0, 43.0, 1.0), (3, None, 0.0, 1.0, 0.7),
            (4, [1.0, None], 0.0, 1.0, 0.7)]
    df = spark.createDataFrame(rows, "key long, phi array<double>, bias double, logit double, probability double")
    fine = explain.additivity_audit(df.where("key < 3")).first()
    assert (fine.rows, fine.audited, fine.worst, fine.additive) == (2, 2, 0.0, True)
    some = explain.additivity_audit(df).first()
    assert (some.rows, some.audited, some.additive) == (4, 2, False)


def test_importance_leaves_out_arrays_of_another_width(spark):
    rows = [([1.0, -3.0],), ([5.0, float("nan"), 9.0],), ([7.0],), (None,), ([0.0, 0.0],)]
    df = spark.createDataFrame(rows, "phi array<double>")
    got = {r.column: (r.mean_size, r.rows_on_top) for r in explain.importance(df, ["a", "b"]).collect()}
    assert got == {"a": (2.0, 2), "b": (1.0, 1)}
