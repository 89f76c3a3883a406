from pyspark.sql import functions as F
import pytest

from ebbtide.operators import actions, brief, explain
from ebbtide.schema import DRIVER_TYPE

# A customer on a monthly contract, lately unhappy, of unknown charges.
SAMPLE = [
    ("Contract", 1.0, 0.61, "up"),
    ("MonthlyCharges", None, 0.275, "up"),
    ("SatisfactionScore", 2.0, 0.09, "up"),
    ("OnlineBackup", 1.0, 0.0625, "down"),
]
KIND = f"array<{DRIVER_TYPE.simpleString()}>"


@pytest.fixture
def frame(spark):
    def make(features=SAMPLE, p=0.58, tier="Medium", missing=None):
        return spark.createDataFrame(
            [(p, tier, features, missing)],
            f"churn_probability double, retention_risk string, feature_importance {KIND}, missing array<string>",
        )
    return make


def titles(df):
    return [p.title for p in actions.with_precautions(df, "missing").first().precautions]


def test_top_drivers(frame):
    df = frame()
    got = df.select(explain.top_drivers(F.col("feature_importance"), 2)).first()[0]
    assert [d.feature for d in got] == ["Contract", "MonthlyCharges"]
    assert frame(None).select(explain.top_drivers(F.col("feature_importance"))).first()[0] == []
    assert frame([]).select(explain.top_drivers(F.col("feature_importance"))).first()[0] == []


def test_driver_text(frame):
    text = frame().select(actions.driver_text(F.col("feature_importance"))).first()[0]
    assert text == ("Contract=1 (+0.610); MonthlyCharges=? (+0.275); SatisfactionScore=2 (+0.090); "
                    "OnlineBackup=1 (-0.063)")


def test_precautions_follow_the_drivers(frame):
    assert titles(frame()) == [
        "Contract migration incentive", "Satisfaction-recovery outreach", "Above-baseline alert"]
    made = actions.with_precautions(frame()).first().precautions
    assert [p.id for p in made[:2]] == ["contract-mtm", "satisfaction-0.09"]


def test_alert_and_caution(frame):
    assert titles(frame([], 0.39)) == []
    got = actions.with_precautions(frame([], 0.55, missing=["tenure"]), "missing").first().precautions
    assert [p.title for p in got] == ["Above-baseline alert", "Incomplete customer record"]
    assert "55.0%" in got[0].body
    assert got[1].body.startswith("1 key field(s) are blank: tenure. ")
    assert titles(frame(SAMPLE, None)) == []


def test_one_precaution_per_label_and_none_for_others(frame):
    features = [("Contract: One Year", 0.0, 0.5, "up"), ("Contract: Two Year", 0.0, 0.4, "up"),
                ("Contract: One Year", 0.0, 0.3, "up"), ("Married", 0.0, 0.2, "up"),
                ("CLTV", 0.0, 0.06, "up"), ("tenure", 0.0, 0.055, "up")]
    assert titles(frame(features, 0.1)) == [
        "Contract migration incentive", "Contract migration incentive", "Lifetime-value flag"]


def test_request(frame):
    df = actions.with_retention_request(actions.with_precautions(frame()))
    request = df.first().request
    assert request.risk_level == "Medium" and request.probability_pct == 58.0
    assert request.top_drivers == ["Contract (0.610)", "MonthlyCharges (0.275)", "SatisfactionScore (0.090)"]
    assert request.risk_signals[-1] == "Above-baseline alert"


REQUEST = ("struct<risk_level:string,reasons:string,top_drivers:array<string>,"
           "risk_signals:array<string>,probability_pct:double>")


def test_brief(spark):
    def text(*request):
        df = spark.createDataFrame([(request,)], f"r {REQUEST}")
        return df.select(brief.brief(F.col("r"))).first()[0]

    full = text("High", "x=1", ["SatisfactionScore (0.42)"], ["Pricing review"], 78.5)
    assert "flagged as a High churn risk (predicted probability 78.5%). Operational notes from the form: x=1.\n\n" in full
    assert "descending):\n  - SatisfactionScore (0.42)\n\nCustomer-specific" in full
    assert "\n  - Pricing review\n\nProduce an internal" in full
    short = text("Low", "Loyal customer.", None, None, None)
    assert "Low churn risk. Operational" in short and brief.DRIVERS_HEADING not in short


def test_plans_and_tags(spark):
    texts = ["  - Lock the term. ", "", " \n ", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plans = [r[0] for r in df.select(brief.plan(F.col("t"))).collect()]
    assert plans == ["[Action Plan] - Lock the term.", *[brief.DEFAULT_PLAN] * 3]
    assert brief.DEFAULT_PLAN.count("[") == 1

    tagged = ["[Action Plan] a", "[Default Action Plan]\nb", "[Generated by LLM] c", "d", "", None]
    got = spark.createDataFrame([(t,) for t in tagged], "t string").select(
        brief.plan_badge(F.col("t")), brief.plan_body(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [
        ("LLM", "a"), ("Default", "b"), (None, "[Generated by LLM] c"), (None, "d"),
        (None, brief.NO_PLAN), (None, brief.NO_PLAN)]


def test_slots(spark):
    df = spark.createDataFrame([("big",), (" big ",), ("no",), (None,)], "s string")
    slots = {"small": "S", "big": "B"}
    got = df.select(brief.choose_slot(F.col("s"), slots, "small")).collect()
    assert [r[0] for r in got] == ["B", "B", "S", "S"]
