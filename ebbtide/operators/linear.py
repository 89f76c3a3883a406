"""A linear log-odds scorer: a model whose score and contributions any SQL engine
can recompute, used to check the scoring and explanation steps exactly."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ebbtide.functions.plans import double, once, quoted
from ebbtide.schema import FEATURE_COLUMNS

# Our own coefficients: (weight, mean) per feature column; other columns weigh 0.
TERMS: dict[str, tuple[float, float]] = {
    "Partner": (-0.15, 0.5),
    "Dependents": (-0.35, 0.25),
    "Tenure_in_Months": (-0.03, 36.0),
    "Phone_Service": (0.05, 0.9),
    "Multiple_Lines": (0.1, 0.4),
    "Internet_Service": (0.2, 0.75),
    "Online_Security": (-0.45, 0.3),
    "Online_Backup": (-0.2, 0.35),
    "Device_Protection_Plan": (-0.2, 0.35),
    "Premium_Tech_Support": (-0.4, 0.3),
    "Streaming_TV": (0.15, 0.4),
    "Streaming_Movies": (0.15, 0.4),
    "Paperless_Billing": (0.25, 0.6),
    "Monthly_Charge": (0.02, 65.0),
    "Total_Charges": (-0.0001, 2000.0),
    "Married": (-0.1, 0.5),
    "Number_of_Dependents": (-0.15, 0.5),
    "Number_of_Referrals": (-0.12, 2.0),
    "Satisfaction_Score": (-0.9, 3.2),
    "Age": (0.01, 46.0),
    "Avg_Monthly_GB_Download": (0.001, 20.0),
    "Avg_Monthly_Long_Distance_Charges": (0.004, 23.0),
    "CLTV": (-0.0003, 4400.0),
    "Under_30": (0.1, 0.2),
    "Unlimited_Data": (0.1, 0.7),
    "Streaming_Music": (0.05, 0.35),
    "Referred_a_Friend": (-0.3, 0.45),
    "Total_Refunds": (0.01, 2.0),
    "Total_Extra_Data_Charges": (0.005, 7.0),
    "Total_Long_Distance_Charges": (-0.0002, 750.0),
    "Total_Revenue": (-0.0001, 3000.0),
    "Contract_Month_to_Month": (1.1, 0.5),
    "Contract_One_Year": (-0.5, 0.22),
    "Contract_Two_Year": (-1.2, 0.28),
    "Gender_Female": (0.02, 0.5),
    "Gender_Male": (-0.02, 0.5),
    "Internet_Type_Cable": (0.1, 0.12),
    "Internet_Type_DSL": (-0.15, 0.23),
    "Internet_Type_Fiber_Optic": (0.45, 0.43),
    "Internet_Type_null": (-0.4, 0.22),
    "Offer_Offer_A": (-0.5, 0.07),
    "Offer_Offer_B": (-0.3, 0.12),
    "Offer_Offer_C": (-0.1, 0.06),
    "Offer_Offer_D": (0.15, 0.09),
    "Offer_Offer_E": (0.7, 0.11),
    "Offer_null": (0.05, 0.55),
    "Payment_Method_Bank_Withdrawal": (0.2, 0.55),
    "Payment_Method_Credit_Card": (-0.3, 0.39),
    "Payment_Method_Mailed_Check": (0.35, 0.06),
    "Senior_Citizen_0": (-0.05, 0.84),
    "Senior_Citizen_1": (0.3, 0.16),
}


@dataclass(frozen=True)
class LinearModel:
    """Log-odds = bias + sum of weight * (value - mean)."""

    terms: Mapping[str, tuple[float, float]] = field(default_factory=lambda: TERMS)
    bias: float = 0.25
    columns: tuple[str, ...] = FEATURE_COLUMNS

    def _term(self, name: str) -> tuple[float, float]:
        return self.terms.get(name, (0.0, 0.0))

    @property
    def intercept(self) -> float:
        """The log-odds of an all-zero record, added up in column order."""
        total = self.bias
        for name in self.columns:
            weight, mean = self._term(name)
            total = total - weight * mean
        return total

    def logit(self) -> Column:
        """One sum in column order, so every engine rounds alike."""
        terms = [double(self.intercept)]
        terms += [f"{double(self._term(c)[0])} * {quoted(c)}" for c in self.columns]
        return F.expr(" + ".join(terms))

    def contributions(self) -> Column:
        terms = (
            f"{double(w)} * ({quoted(c)} - {double(m)})"
            for c in self.columns
            for w, m in [self._term(c)]
        )
        return F.expr(f"array({', '.join(terms)})")

    def values(self) -> Column:
        return feature_array(self.columns)

    def score(self, frame: DataFrame) -> DataFrame:
        """Add ``logit`` and ``probability`` to an aligned frame."""
        scored = once(frame, {"logit": self.logit()})
        return scored.withColumn("probability", logistic(F.col("logit")))

    def explain(self, scored: DataFrame) -> DataFrame:
        """Add ``phi``, ``bias`` and ``feature_values`` to a scored frame."""
        return once(scored, {
            "phi": self.contributions(),
            "bias": F.lit(self.bias),
            "feature_values": self.values(),
        })


def feature_array(columns: Sequence[str]) -> Column:
    """The feature columns as one array of doubles."""
    return F.expr("array(" + ", ".join(f"cast({quoted(c)} AS double)" for c in columns) + ")")


def logistic(logit: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))
