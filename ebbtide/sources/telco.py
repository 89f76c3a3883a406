"""The customer record derived from order tables, and a damaged text form of it.

Only integer arithmetic, decimal sums and single divisions are used, so any SQL
engine arrives at the same values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ebbtide.functions.plans import text
from ebbtide.schema import CATEGORY, FIELDS, YES_NO_FIELDS

CUTOFF = "2000-08-01 00:00:00"

# flag -> (a, j, t): the flag is set where (key * a + j) % 101 < t.
FLAG_RULES = {
    "SeniorCitizen": (7, 0, 16),
    "Partner": (37, 5, 48),
    "Dependents": (11, 9, 30),
    "PhoneService": (13, 2, 90),
    "MultipleLines": (17, 8, 42),
    "InternetService": (19, 4, 78),
    "OnlineSecurity": (23, 6, 29),
    "OnlineBackup": (31, 1, 34),
    "DeviceProtection": (41, 3, 35),
    "TechSupport": (43, 7, 28),
    "StreamingTV": (47, 10, 38),
    "StreamingMovies": (53, 12, 39),
    "PaperlessBilling": (59, 14, 59),
    "Married": (61, 16, 48),
    "UnlimitedData": (67, 18, 67),
    "StreamingMusic": (71, 20, 35),
    "ReferredAFriend": (73, 22, 45),
}

# count -> (start, a, size): start + (key * a) % size.
COUNT_RULES = {
    "Age": (18, 17, 63),
    "NumberOfDependents": (0, 19, 6),
    "NumberOfReferrals": (0, 23, 11),
    "AvgMonthlyGBDownload": (0, 31, 500),
    "CLTV": (2000, 41, 4500),
    "TotalExtraDataCharges": (0, 43, 21),
}

# money -> (start, a, size): cents, start + (key * a) % size.
MONEY_RULES = {
    "MonthlyCharges": (2000, 89, 10007),
    "AvgMonthlyLongDistanceCharges": (0, 97, 5003),
    "TotalRefunds": (0, 101, 4999),
    "TotalLongDistanceCharges": (0, 103, 30011),
}

SEGMENT_OFFERS = {
    "AUTOMOBILE": "Offer A",
    "BUILDING": "Offer B",
    "FURNITURE": "Offer C",
    "MACHINERY": "Offer D",
    "HOUSEHOLD": "None",
}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _order_history(orders: DataFrame) -> DataFrame:
    """One row per customer. The sums run map-side first, so a customer that owns a
    large share of all orders reaches the shuffle as one row per task."""
    cutoff = F.lit(CUTOFF).cast("timestamp_ntz")
    before = F.col("o_orderdate") < cutoff
    price = F.col("o_totalprice").cast("decimal(18,2)")
    return orders.groupBy(F.col("o_custkey").alias("key")).agg(
        F.min(F.when(before, F.col("o_orderdate"))).alias("first_order"),
        F.max("o_orderdate").alias("last_order"),
        F.sum(F.when(before, price)).alias("spent"),
    )


def customers(spark: SparkSession, folder: str) -> DataFrame:
    """``key``, the 37 fields and ``Churn`` for every row of the customer table."""
    base = _table(spark, folder, "customer").select(
        F.col("c_custkey").alias("key"), "c_nationkey", "c_mktsegment"
    )
    history = _order_history(_table(spark, folder, "orders"))
    joined = base.join(history, "key", "left")

    values = {
        n: f"cast((key * {a} + {j}) % 101 < {t} AS bigint)" for n, (a, j, t) in FLAG_RULES.items()
    }
    for name, (start, a, size) in COUNT_RULES.items():
        values[name] = f"{start}L + key * {a} % {size}"
    for name, (start, a, size) in MONEY_RULES.items():
        values[name] = f"cast({start}L + key * {a} % {size} AS double) / 100D"
    offers = " ".join(f"WHEN {text(s)} THEN {text(o)}" for s, o in SEGMENT_OFFERS.items())
    cutoff = f"timestamp_ntz'{CUTOFF}'"
    spent = "coalesce(cast(spent AS double), 0D) / 1000D"
    values |= {
        "Gender": "CASE WHEN key % 2 = 0 THEN 'Male' ELSE 'Female' END",
        "Under30": f"cast({values['Age']} < 30 AS bigint)",
        "tenure": f"coalesce(floor(datediff({cutoff}, first_order) / 30), 0L)",
        "Contract": "CASE WHEN (key * 29 + 3) % 101 < 55 THEN 'Month-to-Month' "
                    "WHEN (key * 29 + 3) % 101 < 78 THEN 'One Year' ELSE 'Two Year' END",
        "Offer": f"CASE WHEN key % 23 = 0 THEN 'Offer E' ELSE CASE c_mktsegment {offers} END END",
        "InternetType": "elt(c_nationkey % 4 + 1, 'Cable', 'DSL', 'Fiber Optic', NULL)",
        "PaymentMethod":
            "elt(cast(key % 3 + 1 AS int), 'Bank Withdrawal', 'Credit Card', 'Mailed Check')",
        "SatisfactionScore": "1L + (key * 13 + 1) % 5",
        "TotalCharges": spent,
        "TotalRevenue": f"{spent} + {values['TotalLongDistanceCharges']}",
    }
    return joined.selectExpr(
        "key",
        *[f"{values[f.name]} AS {f.name}" for f in FIELDS],
        f"cast(coalesce(last_order < {cutoff}, true) AS int) AS Churn",
    )


def training_table(df: DataFrame) -> DataFrame:
    """The same customers as a training table: dataset spelling, nulls for "None",
    charges as text with blanks, a few columns no model may see, the target as is."""
    from ebbtide.operators.encode import rename_fields

    offer = F.when(F.col("Offer") == "None", None).otherwise(F.col("Offer"))
    charges = F.when(F.col("key") % 17 == 0, " ").otherwise(F.col("TotalCharges").cast("string"))
    return rename_fields(df.withColumns({"Offer": offer, "TotalCharges": charges})).withColumns({
        "Customer ID": F.concat(F.lit("C-"), F.col("key").cast("string")),
        "Churn Reason": F.lit("unknown"),
        "Zip Code": F.col("key") % 1000,
    })


# key % 20 -> {field: JSON token}; the defects of the damaged records.
DEFECTS: dict[int, dict[str, str]] = {
    0: {"TotalCharges": '" "'},
    1: {"Partner": "2"},
    2: {"SatisfactionScore": "9"},
    3: {"MonthlyCharges": "-5.5"},
    5: {"MonthlyCharges": "NaN"},
    6: {"Offer": '""'},
    7: {"SeniorCitizen": "1.5"},
    8: {"tenure": '"abc"'},
    9: {"tenure": "null", "Contract": '""', "SatisfactionScore": "null", "MonthlyCharges": "null"},
    10: {"Gender": "123"},
    11: {"tenure": '"12"'},
    13: {"MonthlyCharges": "50"},
    14: {"Partner": "true", "CLTV": "1e3"},
}
UNKNOWN_FIELD_REST, MALFORMED_REST, ARRAY_REST = 4, 12, 15


def _by_rest(name: str, value: str, defects: dict[int, dict[str, str | None]]) -> str:
    """SQL for a field's value, replaced where key % 20 says so."""
    cases = " ".join(
        f"WHEN {rest} THEN {'NULL' if fields[name] is None else text(fields[name])}"
        for rest, fields in defects.items() if name in fields
    )
    return f"CASE key % 20 {cases} ELSE {value} END" if cases else value


def damaged_records(df: DataFrame) -> DataFrame:
    """``key`` and ``raw``: each customer as JSON text, most of them with one defect."""
    parts = []
    for f in FIELDS:
        token = f"""concat('"', {f.name}, '"')""" if f.kind == CATEGORY else f"cast({f.name} AS string)"
        token = _by_rest(f.name, f"coalesce({token}, 'null')", DEFECTS)
        parts.append(f"""concat('"{f.name}":', {token})""")
    parts.append(f"""CASE WHEN key % 20 = {UNKNOWN_FIELD_REST} THEN '"Loyalty":1' END""")
    body = f"concat_ws(',', {', '.join(parts)})"
    return df.selectExpr("key", f"{body} AS body").selectExpr(
        "key",
        f"CASE key % 20 WHEN {MALFORMED_REST} THEN concat('{{', body) "
        f"WHEN {ARRAY_REST} THEN concat('[', cast(key AS string), ']') "
        "ELSE concat('{', body, '}') END AS raw",
    )


# rest of key % 20 -> {field: value}; None is a null.
GAPS: dict[int, dict[str, str | None]] = {
    1: {"Offer": None},
    3: {"SeniorCitizen": None},
    5: {"tenure": None, "Contract": None},
    7: {"MonthlyCharges": None, "TotalCharges": None},
    9: {"Gender": None, "PaymentMethod": None, "Partner": None},
    11: {"Offer": "", "InternetType": "None"},
    13: {"Contract": "None", "Offer": "Offer Z"},
    15: {"InternetType": "", "SatisfactionScore": None, "MonthlyCharges": None},
}
FORM_DEFECTS: dict[int, dict[str, str | None]] = {
    0: {"TotalCharges": " "},
    1: {"Partner": "2"},
    2: {"SatisfactionScore": "9", "tenure": "2.5"},
    3: {"MonthlyCharges": "-5.5"},
    4: {"MonthlyCharges": "NaN", "TotalRefunds": "Infinity"},
    5: {"SeniorCitizen": "1.5"},
    6: {"tenure": "abc", "CLTV": "1d"},
    7: {"tenure": "", "Contract": "", "SatisfactionScore": "", "MonthlyCharges": ""},
    8: {"Age": "+12", "TotalRevenue": "1e3"},
    9: {"Offer": ""},
    10: {"Partner": "", "SatisfactionScore": "0"},
    11: {"MonthlyCharges": "", "Contract": None},
}
# Spellings a flag may come in, by (key + position) % 7.
FLAG_SPELLINGS = ("Yes", "No", "1", "0", "maybe", "", None)


def with_gaps(df: DataFrame) -> DataFrame:
    """Customers with missing values, sentinels and unseen categories."""
    return df.selectExpr(*[f"{_by_rest(c, c, GAPS)} AS {c}" for c in df.columns])


def as_form(df: DataFrame) -> DataFrame:
    """Customers as a form hands them over: text throughout, some of it wrong."""
    return df.selectExpr("key", *[
        f"{_by_rest(f.name, f'cast({f.name} AS string)', FORM_DEFECTS)} AS {f.name}"
        for f in FIELDS
    ])


def with_spelled_flags(df: DataFrame) -> DataFrame:
    """Customers whose Yes/No fields come in every spelling, good and bad."""
    words = ", ".join("NULL" if x is None else text(x) for x in FLAG_SPELLINGS)
    n = len(FLAG_SPELLINGS)
    return df.selectExpr(*[
        f"elt(cast((key + {YES_NO_FIELDS.index(c)}) % {n} + 1 AS int), {words}) AS {c}"
        if c in YES_NO_FIELDS else c
        for c in df.columns
    ])
