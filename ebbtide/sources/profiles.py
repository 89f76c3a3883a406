"""The two reference customers every score is compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ebbtide.functions.flags import normalise_flags
from ebbtide.schema import FIELDS, RECORD_SCHEMA, YES_NO_FIELDS

# The two profiles. Neither states a CLTV, so it scores as 0.
PROFILES: dict[str, dict[str, str | int]] = {
    "highRisk": {
        "Gender": "Male",
        "SeniorCitizen": "No",
        "Partner": "No",
        "Dependents": "No",
        "Married": "No",
        "Under30": "Yes",
        "ReferredAFriend": "No",
        "Age": 28,
        "NumberOfDependents": 0,
        "NumberOfReferrals": 0,
        "SatisfactionScore": 2,
        "tenure": 2,
        "Contract": "Month-to-Month",
        "Offer": "None",
        "PaperlessBilling": "Yes",
        "PaymentMethod": "Bank Withdrawal",
        "PhoneService": "Yes",
        "MultipleLines": "No",
        "InternetService": "Yes",
        "InternetType": "Fiber Optic",
        "OnlineSecurity": "No",
        "OnlineBackup": "No",
        "DeviceProtection": "No",
        "TechSupport": "No",
        "StreamingTV": "Yes",
        "StreamingMovies": "Yes",
        "StreamingMusic": "No",
        "UnlimitedData": "Yes",
        "AvgMonthlyLongDistanceCharges": 5,
        "AvgMonthlyGBDownload": 80,
        "MonthlyCharges": 95,
        "TotalCharges": 190,
        "TotalRefunds": 0,
        "TotalExtraDataCharges": 10,
        "TotalLongDistanceCharges": 20,
        "TotalRevenue": 200,
    },
    "loyal": {
        "Gender": "Female",
        "SeniorCitizen": "No",
        "Partner": "Yes",
        "Dependents": "Yes",
        "Married": "Yes",
        "Under30": "No",
        "ReferredAFriend": "Yes",
        "Age": 54,
        "NumberOfDependents": 2,
        "NumberOfReferrals": 4,
        "SatisfactionScore": 5,
        "tenure": 60,
        "Contract": "Two Year",
        "Offer": "Offer E",
        "PaperlessBilling": "Yes",
        "PaymentMethod": "Credit Card",
        "PhoneService": "Yes",
        "MultipleLines": "Yes",
        "InternetService": "Yes",
        "InternetType": "Fiber Optic",
        "OnlineSecurity": "Yes",
        "OnlineBackup": "Yes",
        "DeviceProtection": "Yes",
        "TechSupport": "Yes",
        "StreamingTV": "Yes",
        "StreamingMovies": "Yes",
        "StreamingMusic": "Yes",
        "UnlimitedData": "Yes",
        "AvgMonthlyLongDistanceCharges": 25,
        "AvgMonthlyGBDownload": 40,
        "MonthlyCharges": 89,
        "TotalCharges": 5340,
        "TotalRefunds": 0,
        "TotalExtraDataCharges": 0,
        "TotalLongDistanceCharges": 1500,
        "TotalRevenue": 5500,
    },
}


def profiles(spark: SparkSession) -> DataFrame:
    """``profile`` and the 37 fields; Yes/No already turned into 0/1."""
    rows = [
        (name, *(None if f.name not in p else str(p[f.name]) for f in FIELDS))
        for name, p in PROFILES.items()
    ]
    text = spark.createDataFrame(rows, "profile string, " + ", ".join(
        f"{f.name} string" for f in FIELDS
    ))
    return normalise_flags(text).select("profile", *[
        F.col(f.name).cast(RECORD_SCHEMA[f.name].dataType).alias(f.name) for f in FIELDS
    ])


def profile(spark: SparkSession, name: str) -> DataFrame:
    if name not in PROFILES:
        raise ValueError(f"unknown profile {name!r}; known: {', '.join(PROFILES)}")
    return profiles(spark).filter(F.col("profile") == name)


if not all(f in p for p in PROFILES.values() for f in YES_NO_FIELDS):
    raise ValueError("a profile lacks a Yes/No field")
