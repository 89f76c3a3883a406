import pytest
from pyspark.sql import functions as F

from ebbtide.functions.labels import label_feature
from ebbtide.operators import clean, encode
from ebbtide.schema import (
    BY_NAME, DATASET_NAMES, FEATURE_COLUMNS, FIELD_NAMES, FIELDS, FLAG, DataConfig, check_contract,
    sanitise,
)
from ebbtide.sources import generator, telco


def first(df):
    return df.orderBy("key").first().asDict()


def test_contract():
    check_contract()
    assert sum(f.kind == FLAG for f in FIELDS) == 17
    assert set(DATASET_NAMES) == set(FIELD_NAMES)
    assert BY_NAME["tenure"].column == "Tenure_in_Months"


def test_record_becomes_51_numeric_columns(records):
    frame = encode.features(records({}))
    assert tuple(frame.columns) == ("key", *FEATURE_COLUMNS)
    assert all(kind in ("int", "bigint", "double") for _, kind in frame.dtypes)
    row = first(frame)
    assert row["Contract_Month_to_Month"] == 1 and row["Contract_Two_Year"] == 0
    assert (row["Senior_Citizen_0"], row["Senior_Citizen_1"]) == (1, 0)
    assert row["Offer_Offer_B"] == 1 and row["Offer_null"] == 0
    assert row["Partner"] == 1 and row["Monthly_Charge"] == 70.5


@pytest.mark.parametrize("value, null_flag", [("None", 1), ("", 1), (None, 1), ("Offer Z", 0)])
def test_offer_sentinels(records, value, null_flag):
    row = first(encode.features(records({"Offer": value})))
    assert row["Offer_null"] == null_flag
    assert sum(row[c] for c in FEATURE_COLUMNS if c.startswith("Offer")) == null_flag


def test_null_means_missing_or_absent(records):
    df = records({"Offer": None, "InternetType": None, "SeniorCitizen": None})
    missing = first(encode.features(df))
    absent = first(encode.features(df, null_means=encode.NULL_IS_ABSENT))
    assert (missing["Offer_null"], missing["Internet_Type_null"], missing["Senior_Citizen_0"]) == (1, 1, 1)
    assert (absent["Offer_null"], absent["Internet_Type_null"], absent["Senior_Citizen_0"]) == (0, 0, 0)


def test_missing_result_does_not_depend_on_other_rows(records):
    alone = first(encode.features(records({"Offer": None})))
    together = first(encode.features(records({"Offer": None}, {"Offer": "Offer A"})))
    assert alone == together


def test_sentinel_elsewhere_is_just_an_unknown_category(records):
    row = first(encode.features(records({"Contract": "None"})))
    assert sum(row[c] for c in FEATURE_COLUMNS if c.startswith("Contract")) == 0


def test_odd_senior_value_counts_as_zero(records):
    row = first(encode.features(records({"SeniorCitizen": 7})))
    assert (row["Senior_Citizen_0"], row["Senior_Citizen_1"]) == (1, 0)


def test_partial_record_is_filled_with_zeros(spark):
    df = spark.createDataFrame([(1, "Male", 5, 70.0)], "key long, Gender string, tenure long, MonthlyCharges double")
    frame, report = encode.align(encode.encode(df))
    row = first(frame)
    assert row["Gender_Male"] == 1 and row["Tenure_in_Months"] == 5 and row["Senior_Citizen_0"] == 0
    assert "CLTV" in report.missing and not report.extras


def test_align(spark):
    df = spark.createDataFrame([(1, 2, 3)], "key long, a long, b long")
    same, report = encode.align(df, ["a", "b"])
    assert same.first() == (1, 2, 3) and report == encode.AlignReport()
    frame, report = encode.align(df, ["c", "b"])
    assert frame.first() == (1, 0, 3)
    assert report.missing == ("c",) and report.extras == ("a",)
    assert encode.align(df, None)[0].columns == df.columns
    with pytest.raises(encode.EmptyFeatureFrame):
        encode.align(df.select("key"), ["a"])


def test_charges_text(spark):
    df = spark.createDataFrame([(1, "100.5"), (2, "  "), (3, None)], "key long, TotalCharges string")
    frame = encode.encode(df).orderBy("key")
    assert [r.Total_Charges for r in frame.collect()] == [100.5, 0.0, 0.0]
    junk = spark.createDataFrame([(1, "abc")], "key long, TotalCharges string")
    with pytest.raises(Exception, match="not a number in Total Charges"):
        encode.encode(junk).collect()
    assert encode.encode(junk, lenient_charges=True).first().Total_Charges == 0.0


def test_yes_no_text_in_a_flag_counts_as_zero(spark):
    df = spark.createDataFrame([(1, "Yes"), (2, "1")], "key long, Partner string")
    assert [r.Partner for r in encode.encode(df).orderBy("key").collect()] == [0.0, 1.0]


def test_names_are_sanitised_and_may_not_collide(spark):
    assert sanitise("A-B c") == "A_B_c"
    df = spark.createDataFrame([(1, 2)], "`A-B` long, `A B` long")
    with pytest.raises(ValueError, match="collide"):
        encode.sanitise_columns(df)


@pytest.mark.parametrize("column, faithful, pretty", [
    ("Tenure_in_Months", "tenure", "Tenure in Months"),
    ("Monthly_Charge", "MonthlyCharges", "Monthly Charge"),
    ("Premium_Tech_Support", "TechSupport", "Premium Tech Support"),
    ("Contract_Month_to_Month", "Contract: Month-to-Month", "Contract: Month-to-Month"),
    ("Internet_Type_Fiber_Optic", "Internet: Type Fiber Optic", "Internet Type: Fiber Optic"),
    ("Senior_Citizen_0", "Senior: Citizen 0", "Senior Citizen: 0"),
    ("Payment_Method_Credit_Card", "Payment: Method Credit Card", "Payment Method: Credit Card"),
    ("PaymentMethod_Other", "Payment Method: Other", "Payment Method: Other"),
    ("unknown", "unknown", "unknown"),
    ("ReferredAFriend_1", "Referred a Friend: 1", "Referred a Friend: 1"),
    ("Under30_0", "Under 30: 0", "Under 30: 0"),
    ("StreamingTV_Yes", "Streaming TV: Yes", "Streaming TV: Yes"),
    ("DeviceProtection_No_internet_service", "Device Protection: No internet service",
     "Device Protection: No internet service"),
    ("InternetType_Fiber_Optic", "Internet Type: Fiber Optic", "Internet Type: Fiber Optic"),
    ("Plan_Month_to_Month", "Plan: Month-to-Month", "Plan: Month-to-Month"),
    ("MonthlyCharges_high", "MonthlyCharges: high", "MonthlyCharges: high"),
])
def test_labels(column, faithful, pretty):
    assert label_feature(column) == faithful
    assert label_feature(column, "pretty") == pretty


def test_training_clean(spark):
    df = spark.createDataFrame(
        [(1, "x", "100.5", 1), (2, "y", " ", 0), (3, "z", "7", None)],
        "key long, `Customer ID` string, TotalCharges string, Churn int",
    )
    rows = clean.clean(df).orderBy("key").collect()
    assert [(r.key, r.TotalCharges, r.Churn) for r in rows] == [(1, 100.5, 1), (2, 0.0, 0)]
    assert "Customer ID" not in rows[0].asDict()
    junk = spark.createDataFrame([(1, "abc", 1)], "key long, TotalCharges string, Churn int")
    with pytest.raises(Exception, match="not a number"):
        clean.clean(junk).collect()


def test_numeric_charges_keep_their_nulls(spark):
    df = spark.createDataFrame([(1, None, 1)], "key long, TotalCharges double, Churn int")
    assert clean.clean(df).first().TotalCharges is None


def test_other_target_is_recoded(spark):
    df = spark.createDataFrame([(1, "yes"), (2, "no"), (3, "maybe"), (4, None)], "key long, Left string")
    config = DataConfig(target="Left", positive="yes", negative="no")
    got = clean.keep_binary_target(df, config)
    assert got.columns == ["key", "Churn"]
    assert sorted(map(tuple, got.collect())) == [(1, 1), (2, 0)]


def test_learned_indicators(spark):
    df = spark.createDataFrame([(1, "M", 1), (2, "F", 0), (3, None, 0)], "key long, Gender string, Churn int")
    frame, dummies = clean.training_frame(df)
    assert dummies.values == {"Gender": ("F", "M", None)}
    assert frame.columns == ["key", "Gender_F", "Gender_M", "Gender_null", "Churn"]
    assert [tuple(r) for r in frame.orderBy("key").collect()] == [
        (1, 0, 1, 0, 1), (2, 1, 0, 0, 0), (3, 0, 0, 1, 0)]


def test_a_large_vocabulary_is_an_error_not_a_cut(spark):
    df = spark.range(50).selectExpr("id AS key", "cast(id AS string) AS name", "1 AS Churn")
    with pytest.raises(clean.VocabularyTooLarge):
        clean.training_frame(df, max_values=10)


def test_both_encoders_agree_on_generated_customers(spark):
    customers = generator.with_planted_churn(generator.generated(spark, 400))
    trained, _ = clean.training_frame(telco.training_table(customers).drop("Churn Reason"))
    fixed = F.when(F.col("key") % 17 == 0, 0.0).otherwise(F.col("TotalCharges"))
    table = customers.withColumn("TotalCharges", fixed).withColumn(
        "InternetType", F.col("InternetType"))
    scored = encode.features(table)
    report = clean.parity(trained, scored).first()
    assert report["rows"] == 400
    # "None" as an internet type is a text of its own in this training table.
    assert set(trained.columns) - set(scored.columns) == {"Churn", "Internet_Type_None"}


def test_generated_rows_do_not_depend_on_partitioning(spark):
    a = generator.customers_for(spark.range(0, 500, 1, 2).withColumnRenamed("id", "key"))
    b = generator.customers_for(spark.range(0, 500, 1, 7).withColumnRenamed("id", "key"))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    assert not a.exceptAll(generator.generated(spark, 500, seed=7)).isEmpty()
