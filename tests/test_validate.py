import json

import pytest
from pyspark.sql import functions as F

from ebbtide.functions import flags
from ebbtide.operators import validate
from ebbtide.schema import FIELD_NAMES, YES_NO_FIELDS
from tests.conftest import RECORD


def errors_of(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "key long, raw string")
    checked = validate.check_records(df).orderBy("key").collect()
    return [r.errors for r in checked]


def text(**changes):
    return json.dumps({**RECORD, **changes})


@pytest.mark.parametrize("changes, error", [
    ({}, None),
    ({"Gender": None, "tenure": None}, None),
    ({"MonthlyCharges": 70}, None),
    ({"Partner": 2}, None),
    ({"Gender": 123}, "Gender:text required"),
    ({"SeniorCitizen": "invalid"}, "SeniorCitizen:integer required"),
    ({"SeniorCitizen": 1.5}, "SeniorCitizen:integer required"),
    ({"SeniorCitizen": 1.0}, "SeniorCitizen:integer required"),
    ({"Partner": True}, "Partner:integer required"),
    ({"MonthlyCharges": "70"}, "MonthlyCharges:number required"),
    ({"MonthlyCharges": float("nan")}, "MonthlyCharges:not finite"),
    ({"TotalRefunds": float("inf")}, "TotalRefunds:not finite"),
    ({"Surprise": 1}, "Surprise:unknown field"),
])
def test_strict_records(spark, changes, error):
    assert errors_of(spark, text(**changes)) == [[error] if error else []]


def test_partial_empty_and_broken_records(spark):
    got = errors_of(spark, "{}", '{"tenure": 5}', "[1]", "5", '{"tenure":', "")
    assert got == [[], [], [validate.NOT_AN_OBJECT], [validate.NOT_AN_OBJECT],
                   [validate.MALFORMED], [validate.MALFORMED]]


def test_all_errors_of_a_record_are_listed(spark):
    assert errors_of(spark, text(Gender=1, tenure="x", More=1)) == [
        ["Gender:text required", "tenure:integer required", "More:unknown field"]]


def test_valid_and_quarantined_records_add_up(spark):
    df = spark.createDataFrame([(1, text()), (2, text(Gender=5))], "key long, raw string")
    checked = validate.check_records(df)
    valid = validate.valid_records(checked, "key").collect()
    assert [r.key for r in valid] == [1]
    assert {n: valid[0][n] for n in FIELD_NAMES} == RECORD
    assert [(r.key, r.errors) for r in validate.quarantine(checked, "key").collect()] == [
        (2, ["Gender:text required"])]


def test_records_are_parsed_once(spark):
    df = spark.createDataFrame([(1, text())], "key long, raw string")
    plan = validate.valid_records(validate.check_records(df), "key")
    shown = plan._jdf.queryExecution().optimizedPlan().toString()
    assert shown.count("parseJson") == 1


@pytest.mark.parametrize("field, value, error", [
    ("Partner", "1", None), ("Partner", "2", "not 0 or 1"), ("Partner", "Yes", "not a number"),
    ("SatisfactionScore", "5", None), ("SatisfactionScore", "6", "not in 1..5"),
    ("tenure", "2.5", "not an integer"), ("tenure", "-1", "negative"),
    ("MonthlyCharges", "1e2", None), ("MonthlyCharges", "-0.5", "negative"),
    ("MonthlyCharges", "Infinity", "not a number"), ("MonthlyCharges", None, None),
])
def test_form_rules(spark, field, value, error):
    df = spark.createDataFrame([(value,)], f"{field} string")
    assert validate.check_ranges(df).first().errors == ([f"{field}:{error}"] if error else [])


def test_form_rules_on_typed_columns(records):
    df = validate.check_ranges(records({}, {"Partner": 3}, {"MonthlyCharges": float("nan")}))
    assert [r.errors for r in df.orderBy("key").collect()] == [
        [], ["Partner:not 0 or 1"], ["MonthlyCharges:not a number"]]


def test_empty_batch(spark):
    with pytest.raises(validate.EmptyBatch):
        validate.require_rows(spark.range(0))
    assert validate.require_rows(spark.range(1)).count() == 1


def test_flags(spark):
    values = ["Yes", "No", "1", "0", "", None, "maybe", "2", "-1"]
    df = spark.createDataFrame([(v,) for v in values], "Partner string")
    assert [r.Partner for r in flags.normalise_flags(df).collect()] == [
        1, 0, 1, 0, None, None, None, None, None]
    assert [r[0] for r in df.select(flags.to_yes_no(F.col("Partner"))).collect()] == [
        "Yes", "No", "Yes", "No", "", "", "", "", ""]
    numbers = spark.createDataFrame([(1,), (0,), (2,)], "Partner int")
    assert [r.Partner for r in flags.normalise_flags(numbers).collect()] == [1, 0, None]
    assert len(YES_NO_FIELDS) == 18


def test_missing_inputs(spark):
    df = spark.createDataFrame([("", "One Year", "3")], "tenure string, Contract string, SatisfactionScore string")
    assert df.select(flags.missing_inputs(df)).first()[0] == ["tenure", "MonthlyCharges"]


def test_score_contract(spark):
    schema = "prediction int, churn_probability double, retention_risk string"
    good = spark.createDataFrame([(1, 0.9, "High"), (0, 0.1, "Low")], schema)
    assert tuple(validate.score_violations(good).first()) == (2, 0, 0, 0)
    bad = spark.createDataFrame([(2, 1.5, "Huge"), (None, None, None)], schema)
    assert tuple(validate.score_violations(bad).first()) == (2, 2, 2, 2)
    with pytest.raises(validate.BrokenScoreContract):
        validate.score_violations(good.drop("prediction"))


def test_flags_in_number_columns(spark):
    df = spark.createDataFrame([(1.0, "1.0"), (0.0, "1"), (0.5, "Yes"), (None, None)], "a double, b string")
    rows = df.select(flags.to_binary(F.col("a")), flags.to_yes_no(F.col("a")),
                     flags.to_binary(F.col("b"))).collect()
    assert [tuple(r) for r in rows] == [(1, "Yes", None), (0, "No", 1), (None, "", 1), (None, "", None)]
