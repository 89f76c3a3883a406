"""The customer record, its vocabularies and the model's feature contract.

Everything that fixes the *shape* of the data lives here, so that the training
encoder, the scoring encoder, the validators and the sources cannot drift apart.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import types as T

CATEGORY, SENIOR, FLAG, COUNT, MONEY = "category", "senior", "flag", "count", "money"


@dataclass(frozen=True)
class Field:
    """One input field: its API spelling, its dataset spelling and its kind."""

    name: str
    dataset: str
    kind: str

    @property
    def column(self) -> str:
        """The sanitised dataset name, as it appears in the feature frame."""
        return sanitise(self.dataset)

    @property
    def spark_type(self) -> T.DataType:
        if self.kind == CATEGORY:
            return T.StringType()
        return T.DoubleType() if self.kind == MONEY else T.LongType()


def sanitise(name: str) -> str:
    """Every character outside ``[a-zA-Z0-9_]`` becomes an underscore."""
    return re.sub(r"[^a-zA-Z0-9_]", "_", name)


# The 37 input fields, API name and dataset name.
FIELDS: tuple[Field, ...] = (
    Field("Gender", "Gender", CATEGORY),
    Field("SeniorCitizen", "Senior Citizen", SENIOR),
    Field("Partner", "Partner", FLAG),
    Field("Dependents", "Dependents", FLAG),
    Field("tenure", "Tenure in Months", COUNT),
    Field("PhoneService", "Phone Service", FLAG),
    Field("MultipleLines", "Multiple Lines", FLAG),
    Field("InternetService", "Internet Service", FLAG),
    Field("OnlineSecurity", "Online Security", FLAG),
    Field("OnlineBackup", "Online Backup", FLAG),
    Field("DeviceProtection", "Device Protection Plan", FLAG),
    Field("TechSupport", "Premium Tech Support", FLAG),
    Field("StreamingTV", "Streaming TV", FLAG),
    Field("StreamingMovies", "Streaming Movies", FLAG),
    Field("Contract", "Contract", CATEGORY),
    Field("PaperlessBilling", "Paperless Billing", FLAG),
    Field("PaymentMethod", "Payment Method", CATEGORY),
    Field("MonthlyCharges", "Monthly Charge", MONEY),
    Field("TotalCharges", "Total Charges", MONEY),
    Field("Married", "Married", FLAG),
    Field("NumberOfDependents", "Number of Dependents", COUNT),
    Field("NumberOfReferrals", "Number of Referrals", COUNT),
    Field("SatisfactionScore", "Satisfaction Score", COUNT),
    Field("InternetType", "Internet Type", CATEGORY),
    Field("Offer", "Offer", CATEGORY),
    Field("Age", "Age", COUNT),
    Field("AvgMonthlyGBDownload", "Avg Monthly GB Download", COUNT),
    Field("AvgMonthlyLongDistanceCharges", "Avg Monthly Long Distance Charges", MONEY),
    Field("CLTV", "CLTV", COUNT),
    Field("Under30", "Under 30", FLAG),
    Field("UnlimitedData", "Unlimited Data", FLAG),
    Field("StreamingMusic", "Streaming Music", FLAG),
    Field("ReferredAFriend", "Referred a Friend", FLAG),
    Field("TotalRefunds", "Total Refunds", MONEY),
    Field("TotalExtraDataCharges", "Total Extra Data Charges", COUNT),
    Field("TotalLongDistanceCharges", "Total Long Distance Charges", MONEY),
    Field("TotalRevenue", "Total Revenue", MONEY),
)

# The categories the model knows, per dataset column.
CATEGORIES: dict[str, tuple[str, ...]] = {
    "Contract": ("Month-to-Month", "One Year", "Two Year"),
    "Gender": ("Female", "Male"),
    "Internet Type": ("Cable", "DSL", "Fiber Optic"),
    "Offer": ("Offer A", "Offer B", "Offer C", "Offer D", "Offer E"),
    "Payment Method": ("Bank Withdrawal", "Credit Card", "Mailed Check"),
}

# Fields in which the text "None" (or "") stands for "no value",
# which the model sees as a category of its own.
NULL_SENTINELS = ("None", "")
NULLABLE_CATEGORIES = ("Internet Type", "Offer")

# Columns a training frame carries but no model may see.
TRAINING_ONLY = (
    "Customer ID", "Churn Category", "Churn Reason", "Churn Score", "Customer Status",
    "City", "Country", "Lat Long", "Latitude", "Longitude", "State", "Zip Code",
    "Quarter", "Population",
)

# Inputs without which a score is only a floor estimate.
KEY_INPUTS = ("tenure", "Contract", "SatisfactionScore", "MonthlyCharges")

TARGET = "Churn"
SENIOR_COLUMN = "Senior Citizen"
CHARGES_COLUMN = "Total Charges"

FIELD_NAMES = tuple(f.name for f in FIELDS)
BY_NAME = {f.name: f for f in FIELDS}
DATASET_NAMES = {f.name: f.dataset for f in FIELDS}
# What a form shows as Yes/No: the flags and the senior citizen field.
YES_NO_FIELDS = tuple(f.name for f in FIELDS if f.kind in (FLAG, SENIOR))


def one_hot_name(column: str, value: str | None) -> str:
    """Name of an indicator column; a missing value is spelled ``null``."""
    return sanitise(f"{column}_{'null' if value is None else value}")


def _one_hot_columns() -> tuple[str, ...]:
    names: list[str] = []
    for column, values in CATEGORIES.items():
        names += [one_hot_name(column, v) for v in values]
        if column in NULLABLE_CATEGORIES:
            names.append(one_hot_name(column, None))
    return (*names, *(one_hot_name(SENIOR_COLUMN, v) for v in ("0", "1")))


NUMERIC_COLUMNS = tuple(f.column for f in FIELDS if f.kind in (FLAG, COUNT, MONEY))
ONE_HOT_COLUMNS = _one_hot_columns()
# The model's contract: 31 numeric columns, then 20 indicators.
FEATURE_COLUMNS = NUMERIC_COLUMNS + ONE_HOT_COLUMNS

RECORD_SCHEMA = T.StructType([T.StructField(f.name, f.spark_type, True) for f in FIELDS])

DRIVER_TYPE = T.StructType([
    T.StructField("feature", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("magnitude", T.DoubleType()),
    T.StructField("direction", T.StringType()),
])


@dataclass(frozen=True)
class DataConfig:
    """How a training table is read and cleaned."""

    drop_columns: tuple[str, ...] = TRAINING_ONLY
    target: str = TARGET
    positive: int | str = 1
    negative: int | str = 0


@dataclass(frozen=True)
class ModelConfig:
    """Training parameters. Level-wise trees take ``trees``, ``depth`` and ``step`` of them."""

    seed: int = 42
    test_share: float = 0.20
    threshold: float = 0.5
    trees: int = 300
    depth: int = 5
    step: float = 0.05
    leaves: int = 31
    l2: float = 0.1
    #: Bins of a column, and what a child of a split must have.
    bins: int = 255
    least_rows: int = 20
    least_hessian: float = 1e-3


HIGH_FROM = 0.70
MEDIUM_FROM = 0.40
DEFAULT_TOP_K = 8


def check_contract() -> None:
    """The field list, its names and the feature contract agree with each other."""
    datasets = [f.dataset for f in FIELDS]
    rules = {
        "37 fields with names of their own":
            len(FIELDS) == 37 and len(set(FIELD_NAMES)) == 37 and len(set(datasets)) == 37,
        "a vocabulary for every category": set(CATEGORIES) == {
            f.dataset for f in FIELDS if f.kind == CATEGORY},
        "31 numeric columns and 20 indicators":
            len(NUMERIC_COLUMNS) == 31 and len(ONE_HOT_COLUMNS) == 20,
        "51 different feature columns": len(set(FEATURE_COLUMNS)) == 51,
        "whole numbers for Yes/No fields":
            all(BY_NAME[n].spark_type == T.LongType() for n in YES_NO_FIELDS),
    }
    broken = [rule for rule, holds in rules.items() if not holds]
    if broken:
        raise ValueError("the field list breaks: " + "; ".join(broken))


check_contract()
