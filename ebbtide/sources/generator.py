"""Random customers as a pure function of (id, seed).

The draws are modular integer arithmetic, so a row is the same whichever task makes
it and whichever engine evaluates the formula.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ebbtide.functions.plans import quoted, text
from ebbtide.schema import FIELDS, FLAG, SENIOR

PRIME = 2_147_483_647
# The vocabularies and ranges the load payloads draw from.
CHOICES: dict[str, tuple[str, ...]] = {
    "Gender": ("Male", "Female"),
    "Contract": ("Month-to-Month", "One Year", "Two Year"),
    "InternetType": ("DSL", "Fiber Optic", "Cable", "None"),
    "PaymentMethod": ("Bank Withdrawal", "Credit Card", "Mailed Check"),
    "Offer": ("None", "Offer A", "Offer B", "Offer C"),
}
COUNTS: dict[str, tuple[int, int]] = {
    "tenure": (1, 72),
    "NumberOfDependents": (0, 5),
    "NumberOfReferrals": (0, 10),
    "SatisfactionScore": (1, 5),
    "Age": (18, 80),
    "AvgMonthlyGBDownload": (0, 500),
    "CLTV": (1000, 8000),
    "TotalExtraDataCharges": (0, 20),
}
AMOUNTS: dict[str, tuple[int, int]] = {
    "MonthlyCharges": (20, 120),
    "TotalCharges": (100, 6000),
    "AvgMonthlyLongDistanceCharges": (0, 50),
    "TotalRefunds": (0, 50),
    "TotalLongDistanceCharges": (0, 300),
    "TotalRevenue": (100, 6000),
}


def multiplier(position: int) -> int:
    return 48_271 + 1_000_003 * position


def draw(key: str, position: int, seed: int) -> str:
    """SQL for an integer in [0, PRIME): one multiplication and two squarings modulo a
    prime. All products stay below 2^62."""
    a = multiplier(position) % PRIME
    first = f"pmod(pmod({key}, {PRIME}L) * {a} + {seed * 7919 + position}, {PRIME}L)"
    second = f"pmod({first} * {first} + {position + 1}, {PRIME}L)"
    return f"pmod({second} * {second} + {first}, {PRIME}L)"


def customers_for(keys: DataFrame, seed: int = 42, key: str = "key") -> DataFrame:
    """A random customer for every key; ``keys`` may be a table or ``spark.range(n)``."""
    k = f"cast({quoted(key)} AS bigint)"
    columns = [f"{k} AS key"]
    for position, f in enumerate(FIELDS):
        u = draw(k, position, seed)
        if f.name in CHOICES:
            words = CHOICES[f.name]
            value = f"elt(cast({u} % {len(words)} + 1 AS int), {', '.join(map(text, words))})"
        elif f.kind in (FLAG, SENIOR):
            value = f"{u} % 2"
        elif f.name in COUNTS:
            low, high = COUNTS[f.name]
            value = f"{low}L + {u} % {high - low + 1}"
        else:
            low, high = AMOUNTS[f.name]
            value = f"cast({low * 100}L + {u} % {(high - low) * 100 + 1} AS double) / 100D"
        columns.append(f"{value} AS {f.name}")
    return keys.selectExpr(*columns)


def with_planted_churn(df: DataFrame, seed: int = 42) -> DataFrame:
    """Add a ``Churn`` label that depends on satisfaction, contract and tenure, for
    tests of learning quality. Percent chances, compared with one more draw."""
    chance = (
        "5 + CASE WHEN SatisfactionScore <= 2 THEN 45 ELSE 0 END"
        " + CASE WHEN Contract = 'Month-to-Month' THEN 30 ELSE 0 END"
        " + CASE WHEN tenure <= 12 THEN 15 ELSE 0 END"
    )
    u = draw("key", len(FIELDS), seed)
    return df.withColumn("Churn", F.expr(f"cast({u} % 100 < {chance} AS int)"))


def generated(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    return customers_for(spark.range(n).withColumnRenamed("id", "key"), seed)
