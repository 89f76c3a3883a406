"""DuckDB SQL for the named queries, written from the rules and not from the plans.

Shared with the library are only constants: names, vocabularies, texts, coefficients.
"""

from __future__ import annotations

import re
from itertools import combinations
from math import factorial

from ebbtide.operators.actions import RULES
from ebbtide.operators.attribution import Node
from ebbtide.operators.brief import (
    DEFAULT_PLAN, DRIVERS_HEADING, INSTRUCTIONS, NO_PLAN, SIGNALS_HEADING,
)
from ebbtide.operators.linear import TERMS
from ebbtide.operators.panel import NARRATIVES
from ebbtide.plans.catalog import FEW_VALUES, FOREST, SLOTS, SMALL, THREE_LEAVES
from ebbtide.schema import (
    CATEGORIES, CATEGORY, COUNT, DATASET_NAMES, FEATURE_COLUMNS, FIELD_NAMES, FIELDS, FLAG,
    KEY_INPUTS, MONEY, NULLABLE_CATEGORIES, SENIOR, YES_NO_FIELDS,
)
from ebbtide.sources import generator as gen, telco
from ebbtide.sources.profiles import PROFILES

BIAS = 0.25
ORACLES: dict[str, str] = {}


# The label of every column, as dashboards show it and pretty.
LABELS = {
    "Partner": ("Partner", "Partner"),
    "Dependents": ("Dependents", "Dependents"),
    "Tenure_in_Months": ("tenure", "Tenure in Months"),
    "Phone_Service": ("PhoneService", "Phone Service"),
    "Multiple_Lines": ("MultipleLines", "Multiple Lines"),
    "Internet_Service": ("InternetService", "Internet Service"),
    "Online_Security": ("OnlineSecurity", "Online Security"),
    "Online_Backup": ("OnlineBackup", "Online Backup"),
    "Device_Protection_Plan": ("DeviceProtection", "Device Protection Plan"),
    "Premium_Tech_Support": ("TechSupport", "Premium Tech Support"),
    "Streaming_TV": ("StreamingTV", "Streaming TV"),
    "Streaming_Movies": ("StreamingMovies", "Streaming Movies"),
    "Paperless_Billing": ("PaperlessBilling", "Paperless Billing"),
    "Monthly_Charge": ("MonthlyCharges", "Monthly Charge"),
    "Total_Charges": ("TotalCharges", "Total Charges"),
    "Married": ("Married", "Married"),
    "Number_of_Dependents": ("NumberOfDependents", "Number of Dependents"),
    "Number_of_Referrals": ("NumberOfReferrals", "Number of Referrals"),
    "Satisfaction_Score": ("SatisfactionScore", "Satisfaction Score"),
    "Age": ("Age", "Age"),
    "Avg_Monthly_GB_Download": ("AvgMonthlyGBDownload", "Avg Monthly GB Download"),
    "Avg_Monthly_Long_Distance_Charges": ("AvgMonthlyLongDistanceCharges", "Avg Monthly Long Distance Charges"),
    "CLTV": ("CLTV", "CLTV"),
    "Under_30": ("Under30", "Under 30"),
    "Unlimited_Data": ("UnlimitedData", "Unlimited Data"),
    "Streaming_Music": ("StreamingMusic", "Streaming Music"),
    "Referred_a_Friend": ("ReferredAFriend", "Referred a Friend"),
    "Total_Refunds": ("TotalRefunds", "Total Refunds"),
    "Total_Extra_Data_Charges": ("TotalExtraDataCharges", "Total Extra Data Charges"),
    "Total_Long_Distance_Charges": ("TotalLongDistanceCharges", "Total Long Distance Charges"),
    "Total_Revenue": ("TotalRevenue", "Total Revenue"),
    "Contract_Month_to_Month": ("Contract: Month-to-Month", "Contract: Month-to-Month"),
    "Contract_One_Year": ("Contract: One Year", "Contract: One Year"),
    "Contract_Two_Year": ("Contract: Two Year", "Contract: Two Year"),
    "Gender_Female": ("Gender: Female", "Gender: Female"),
    "Gender_Male": ("Gender: Male", "Gender: Male"),
    "Internet_Type_Cable": ("Internet: Type Cable", "Internet Type: Cable"),
    "Internet_Type_DSL": ("Internet: Type DSL", "Internet Type: DSL"),
    "Internet_Type_Fiber_Optic": ("Internet: Type Fiber Optic", "Internet Type: Fiber Optic"),
    "Internet_Type_null": ("Internet: Type null", "Internet Type: null"),
    "Offer_Offer_A": ("Offer: Offer A", "Offer: Offer A"),
    "Offer_Offer_B": ("Offer: Offer B", "Offer: Offer B"),
    "Offer_Offer_C": ("Offer: Offer C", "Offer: Offer C"),
    "Offer_Offer_D": ("Offer: Offer D", "Offer: Offer D"),
    "Offer_Offer_E": ("Offer: Offer E", "Offer: Offer E"),
    "Offer_null": ("Offer: null", "Offer: null"),
    "Payment_Method_Bank_Withdrawal": ("Payment: Method Bank Withdrawal", "Payment Method: Bank Withdrawal"),
    "Payment_Method_Credit_Card": ("Payment: Method Credit Card", "Payment Method: Credit Card"),
    "Payment_Method_Mailed_Check": ("Payment: Method Mailed Check", "Payment Method: Mailed Check"),
    "Senior_Citizen_0": ("Senior: Citizen 0", "Senior Citizen: 0"),
    "Senior_Citizen_1": ("Senior: Citizen 1", "Senior Citizen: 1"),
}


def indicator(base: str, value: str | None) -> str:
    return re.sub("[^a-zA-Z0-9_]", "_", f"{base}_{'null' if value is None else value}")


def q(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# --- the customers ----------------------------------------------------------------

def telco_cte() -> str:
    v = {
        n: f"CAST(((key * {a} + {j}) % 101 < {t}) AS BIGINT)"
        for n, (a, j, t) in telco.FLAG_RULES.items()
    }
    v |= {n: f"{s} + (key * {a}) % {m}" for n, (s, a, m) in telco.COUNT_RULES.items()}
    v |= {
        n: f"CAST({s} + (key * {a}) % {m} AS DOUBLE) / CAST(100 AS DOUBLE)"
        for n, (s, a, m) in telco.MONEY_RULES.items()
    }
    segments = " ".join(f"WHEN {q(s)} THEN {q(o)}" for s, o in telco.SEGMENT_OFFERS.items())
    spent = "COALESCE(CAST(spent AS DOUBLE), CAST(0 AS DOUBLE)) / CAST(1000 AS DOUBLE)"
    cutoff = f"TIMESTAMP {q(telco.CUTOFF)}"
    v |= {
        "Gender": "CASE WHEN key % 2 = 0 THEN 'Male' ELSE 'Female' END",
        "Under30": f"CAST(({v['Age']} < 30) AS BIGINT)",
        "tenure": f"COALESCE(CAST(floor(date_diff('day', first_order, {cutoff}) / 30.0) AS BIGINT), 0)",
        "Contract": "CASE WHEN (key*29+3) % 101 < 55 THEN 'Month-to-Month' "
                    "WHEN (key*29+3) % 101 < 78 THEN 'One Year' ELSE 'Two Year' END",
        "Offer": f"CASE WHEN key % 23 = 0 THEN 'Offer E' ELSE CASE c_mktsegment {segments} END END",
        "InternetType": "CASE c_nationkey % 4 WHEN 0 THEN 'Cable' WHEN 1 THEN 'DSL' "
                        "WHEN 2 THEN 'Fiber Optic' END",
        "PaymentMethod": "CASE key % 3 WHEN 0 THEN 'Bank Withdrawal' WHEN 1 THEN 'Credit Card' "
                         "ELSE 'Mailed Check' END",
        "SatisfactionScore": "1 + (key * 13 + 1) % 5",
        "TotalCharges": spent,
        "TotalRevenue": f"{spent} + {v['TotalLongDistanceCharges']}",
    }
    types = {f.name: {CATEGORY: "VARCHAR", MONEY: "DOUBLE"}.get(f.kind, "BIGINT") for f in FIELDS}
    fields = ",\n  ".join(f"CAST({v[n]} AS {types[n]}) AS {n}" for n in FIELD_NAMES)
    return f"""history AS (
  SELECT o_custkey,
    min(o_orderdate) FILTER (WHERE o_orderdate < {cutoff}) AS first_order,
    max(o_orderdate) AS last_order,
    sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE o_orderdate < {cutoff}) AS spent
  FROM orders GROUP BY o_custkey),
telco AS (
  SELECT key, {fields},
    CASE WHEN last_order >= {cutoff} THEN 0 ELSE 1 END AS Churn
  FROM (SELECT c_custkey AS key, c_nationkey, c_mktsegment, h.*
        FROM customer LEFT JOIN history h ON o_custkey = c_custkey))"""


TELCO = telco_cte()


def replaced(name: str, value: str, defects) -> str:
    cases = " ".join(
        f"WHEN {rest} THEN {q(fields[name])}" for rest, fields in defects.items() if name in fields
    )
    return f"CASE key % 20 {cases} ELSE {value} END" if cases else value


GAPS = "gaps AS (SELECT key, {} , Churn FROM telco)".format(
    ", ".join(f"{replaced(n, n, telco.GAPS)} AS {n}" for n in FIELD_NAMES)
)
# Doubles as text: a whole number keeps its ".0" in both engines.
FORM = "form AS (SELECT key, {} FROM telco)".format(", ".join(
    f"{replaced(n, f'CAST({n} AS VARCHAR)', telco.FORM_DEFECTS)} AS {n}" for n in FIELD_NAMES
))
WORDS = "[" + ", ".join(q(w) for w in telco.FLAG_SPELLINGS) + "]"
SPELLED = "spelled AS (SELECT key, Contract, Age, {} FROM telco)".format(", ".join(
    f"{WORDS}[(key + {i}) % {len(telco.FLAG_SPELLINGS)} + 1] AS {n}"
    for i, n in enumerate(YES_NO_FIELDS)
))


# --- encoding ---------------------------------------------------------------------

def hot(test: str) -> str:
    return f"CASE WHEN {test} THEN 1 ELSE 0 END"


def encoding(absent: bool = False, number=lambda n: f"COALESCE({n}, 0)") -> dict[str, str]:
    """Feature column -> SQL over the API names."""
    api = {d: n for n, d in DATASET_NAMES.items()}
    out = {f.column: number(f.name) for f in FIELDS if f.kind in (FLAG, COUNT, MONEY)}
    for base, values in CATEGORIES.items():
        for value in values:
            out[indicator(base, value)] = hot(f"{api[base]} = {q(value)}")
        if base in NULLABLE_CATEGORIES:
            sentinel = f"{api[base]} IN ('None', '')"
            out[indicator(base, None)] = hot(
                sentinel if absent else f"{api[base]} IS NULL OR {sentinel}"
            )
    senior = "CAST(SeniorCitizen AS VARCHAR)"
    zero = f"{senior} IS DISTINCT FROM '1'" + (" AND SeniorCitizen IS NOT NULL" if absent else "")
    out["Senior_Citizen_0"] = hot(zero)
    out["Senior_Citizen_1"] = hot(f"{senior} = '1'")
    assert tuple(out) == FEATURE_COLUMNS
    return out


def enc_cte(source: str, absent: bool = False, name: str = "enc", carry: str = "key") -> str:
    columns = ", ".join(f"{sql} AS {c}" for c, sql in encoding(absent).items())
    return f"{name} AS (SELECT {carry}, {columns} FROM {source})"


ALL51 = ", ".join(FEATURE_COLUMNS)
ORACLES["telco_view"] = with_(TELCO) + "SELECT * FROM telco"
ORACLES["rename_sanitise"] = with_(TELCO) + "SELECT key, Churn, {} FROM telco".format(
    ", ".join(f"{f.name} AS {f.column}" for f in FIELDS)
)
ORACLES["encode_51"] = with_(TELCO, enc_cte("telco")) + "SELECT * FROM enc"
ORACLES["encode_missing"] = with_(TELCO, GAPS, enc_cte("gaps")) + "SELECT * FROM enc"
ORACLES["encode_missing_absent"] = (
    with_(TELCO, GAPS, enc_cte("gaps", absent=True)) + "SELECT * FROM enc"
)


def readable(n: str) -> str:
    """Text as a finite or infinite number, null where it is none."""
    return (f"CASE WHEN regexp_full_match(trim({n}), "
            r"'[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity|nan))'"
            f") THEN TRY_CAST(trim({n}) AS DOUBLE) END")


def text_number(n: str) -> str:
    return f"COALESCE(CASE WHEN NOT isnan({readable(n)}) THEN {readable(n)} END, CAST(0 AS DOUBLE))"


ORACLES["encode_text"] = with_(TELCO, FORM) + "SELECT key, {} FROM form".format(
    ", ".join(f"{sql} AS {c}" for c, sql in encoding(number=text_number).items())
)
DROPPED = {"CLTV": "CLTV", "Tenure_in_Months": "tenure"}
ALIGNED = ", ".join(
    f"0 AS {c}" if c in DROPPED or c.startswith(("Offer", "Senior")) else c for c in FEATURE_COLUMNS
)
ORACLES["align_report"] = with_(TELCO, enc_cte("telco")) + (
    f"SELECT key, {ALIGNED}, 'Tenure_in_Months|CLTV' AS missing, 'Churn' AS extras FROM enc"
)


# --- validation -------------------------------------------------------------------

def damaged_cte() -> str:
    parts = []
    for f in FIELDS:
        token = f"'\"' || {f.name} || '\"'" if f.kind == CATEGORY else f"CAST({f.name} AS VARCHAR)"
        cases = " ".join(
            f"WHEN {rest} THEN {q(fields[f.name])}"
            for rest, fields in telco.DEFECTS.items() if f.name in fields
        )
        token = f"COALESCE({token}, 'null')"
        if cases:
            token = f"CASE key % 20 {cases} ELSE {token} END"
        parts.append(f"'\"{f.name}\":' || {token}")
    parts.append(f"CASE WHEN key % 20 = {telco.UNKNOWN_FIELD_REST} THEN '\"Loyalty\":1' END")
    body = "concat_ws(',', " + ", ".join(parts) + ")"
    return f"""damaged AS (SELECT key, CASE key % 20
  WHEN {telco.MALFORMED_REST} THEN '{{' || body
  WHEN {telco.ARRAY_REST} THEN '[' || key || ']' ELSE '{{' || body || '}}' END AS raw
  FROM (SELECT key, {body} AS body FROM telco))"""


DAMAGED = damaged_cte()
JSON_TYPES = {
    CATEGORY: ("'VARCHAR'", "text required"),
    MONEY: ("'BIGINT', 'UBIGINT', 'DOUBLE'", "number required"),
    COUNT: ("'BIGINT', 'UBIGINT'", "integer required"),
}
JSON_TYPES[FLAG] = JSON_TYPES[SENIOR] = JSON_TYPES[COUNT]


def checked_cte() -> str:
    tags = []
    for f in FIELDS:
        allowed, message = JSON_TYPES[f.kind]
        kind = f"json_type(good, '$.{f.name}')"
        tags.append(f"CASE WHEN {kind} NOT IN ('NULL', {allowed}) THEN '{f.name}:{message}' END")
    known = "[" + ", ".join(map(q, FIELD_NAMES)) + "]"
    extra = (f"array_to_string([k || ':unknown field' FOR k IN json_keys(good) "
             f"IF NOT list_contains({known}, k)], '|')")
    bad_number = r"""regexp_extract(raw, '"(\w+)":(NaN|-?Infinity)', 1)"""
    return f"""parsed AS (SELECT key, raw,
  CASE WHEN json_valid(raw) AND raw NOT LIKE '[%' THEN raw END AS good FROM damaged),
checked AS (SELECT key, raw, good, CASE
  WHEN {bad_number} <> '' THEN {bad_number} || ':not finite'
  WHEN good IS NULL AND raw LIKE '[%' THEN 'record:not an object'
  WHEN good IS NULL THEN 'record:malformed'
  ELSE concat_ws('|', {', '.join(tags)}, NULLIF({extra}, '')) END AS errors
  FROM parsed)"""


CHECKED = checked_cte()
# Integer fields are read from the text: 1e3 or 2.0 never passes the type rule.
TYPED = ", ".join(
    f"json_extract_string(good, '$.{f.name}') AS {f.name}" if f.kind == CATEGORY
    else f"CAST(json_extract_string(good, '$.{f.name}') AS "
         f"{'DOUBLE' if f.kind == MONEY else 'BIGINT'}) AS {f.name}"
    for f in FIELDS
)
VALID = f"valid AS MATERIALIZED (SELECT key, {TYPED}, 0 AS Churn FROM checked WHERE errors = '')"
ORACLES["validate_valid"] = with_(TELCO, DAMAGED, CHECKED, VALID) + (
    f"SELECT key, {', '.join(FIELD_NAMES)} FROM valid"
)
ORACLES["validate_quarantine"] = with_(TELCO, DAMAGED, CHECKED) + (
    "SELECT key, errors FROM checked WHERE errors <> ''"
)
ORACLES["stream_quarantine"] = ORACLES["validate_quarantine"]


def form_tags() -> str:
    tags = []
    for f in FIELDS:
        if f.kind == CATEGORY:
            continue
        n = f"n_{f.name}"
        fine = f"({n} IS NOT NULL AND isfinite({n}))"
        rules = [(f"{f.name} IS NOT NULL AND NOT {fine}", "not a number")]
        if f.kind != MONEY:
            rules.append((f"{fine} AND {n} <> floor({n})", "not an integer"))
        if f.kind in (FLAG, SENIOR):
            rules.append((f"{fine} AND ({n} < 0 OR {n} > 1)", "not 0 or 1"))
        elif f.name == "SatisfactionScore":
            rules.append((f"{fine} AND ({n} < 1 OR {n} > 5)", "not in 1..5"))
        else:
            rules.append((f"{fine} AND {n} < 0", "negative"))
        tags += [f"CASE WHEN {test} THEN '{f.name}:{message}' END" for test, message in rules]
    return "concat_ws('|', " + ", ".join(tags) + ")"


NO_BLANKS = "filled AS (SELECT key, {} FROM form)".format(
    ", ".join(f"NULLIF({n}, '') AS {n}" for n in FIELD_NAMES)
)
NUMBERS = "numbers AS (SELECT *, {} FROM filled)".format(
    ", ".join(f"{readable(f.name)} AS n_{f.name}" for f in FIELDS if f.kind != CATEGORY)
)
JUDGED = f"judged AS (SELECT *, {form_tags()} AS errors FROM numbers)"
ORACLES["validate_form"] = with_(TELCO, FORM, NO_BLANKS, NUMBERS, JUDGED) + (
    "SELECT key, errors FROM judged"
)
ORACLES["form_numbers"] = with_(TELCO, FORM, NO_BLANKS, NUMBERS, JUDGED) + (
    "SELECT key, {} FROM judged WHERE errors = ''".format(", ".join(
        f.name if f.kind == CATEGORY
        else f"CAST(n_{f.name} AS {'DOUBLE' if f.kind == MONEY else 'BIGINT'}) AS {f.name}"
        for f in FIELDS
    ))
)
ORACLES["binary_normalise"] = with_(TELCO, SPELLED) + "SELECT key, Contract, Age, {} FROM spelled".format(
    ", ".join(
        f"CASE WHEN {n} IN ('Yes','1') THEN 1 WHEN {n} IN ('No','0') THEN 0 END AS {n}"
        for n in YES_NO_FIELDS
    )
)
ORACLES["binary_numbers"] = with_(TELCO) + "SELECT key, {} FROM telco".format(", ".join(
    f"CAST(CASE WHEN key % 5 <> 0 AND key % 7 <> 0 THEN {n} END AS INTEGER) AS {n}" for n in YES_NO_FIELDS
))
ORACLES["yes_no_text"] = with_(TELCO, SPELLED) + "SELECT key, {} FROM spelled".format(", ".join(
    f"CASE WHEN {n} IN ('Yes','1') THEN 'Yes' WHEN {n} IN ('No','0') THEN 'No' ELSE '' END AS {n}"
    for n in YES_NO_FIELDS
))


def missing_list() -> str:
    return "concat_ws('|', " + ", ".join(
        f"CASE WHEN {n} IS NULL OR CAST({n} AS VARCHAR) = '' THEN '{n}' END" for n in KEY_INPUTS
    ) + ")"


ORACLES["missing_inputs"] = with_(TELCO, FORM) + f"SELECT key, {missing_list()} AS missing FROM form"


# --- scores -----------------------------------------------------------------------

def d(value: float) -> str:
    return f"CAST('{value!r}' AS DOUBLE)"


def term(c: str) -> tuple[float, float]:
    return TERMS.get(c, (0.0, 0.0))


def intercept() -> float:
    """The log-odds when every feature is 0."""
    total = BIAS
    for weight, mean in map(term, FEATURE_COLUMNS):
        total -= weight * mean
    return total


def logit_sql() -> str:
    return " + ".join([d(intercept())] + [f"{d(term(c)[0])} * {c}" for c in FEATURE_COLUMNS])


LIN = f"""lin AS (SELECT *, 1 / (1 + exp(-logit)) AS p FROM (
  SELECT *, {logit_sql()} AS logit FROM enc))"""
SCORED = """scored AS (SELECT *, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS prediction,
  round(p, 4) AS churn_probability,
  CASE WHEN p >= 0.70 THEN 'High' WHEN p >= 0.40 THEN 'Medium' ELSE 'Low' END AS retention_risk
  FROM lin)"""
SCORE = with_(TELCO, enc_cte("telco"), LIN, SCORED)
FOUR = "SELECT key, prediction, churn_probability, retention_risk FROM scored"
ORACLES["score_linear"] = SCORE + FOUR
ORACLES["score_with_gaps"] = with_(TELCO, GAPS, enc_cte("gaps", absent=True), LIN, SCORED) + FOUR
ORACLES["score_file_output"] = SCORE + (
    "SELECT t.*, s.churn_probability, s.prediction FROM telco t JOIN scored s ON t.key = s.key"
)
ORACLES["score_file_quarantine"] = with_(TELCO, FORM, NO_BLANKS, NUMBERS, JUDGED) + (
    "SELECT key, errors FROM judged WHERE errors <> ''"
)
GOOD = "good AS ({})".format("SELECT key, {} FROM judged WHERE errors = ''".format(", ".join(
    f.name if f.kind == CATEGORY
    else f"CAST(n_{f.name} AS {'DOUBLE' if f.kind == MONEY else 'BIGINT'}) AS {f.name}" for f in FIELDS
)))
ORACLES["score_file_scores"] = with_(
    TELCO, FORM, NO_BLANKS, NUMBERS, JUDGED, GOOD, enc_cte("good"), LIN, SCORED
) + """SELECT s.key, g.tenure, s.churn_probability, s.prediction
FROM scored s JOIN good g ON g.key = s.key"""
SUMMARY = "count(*) AS total_records, count(*) FILTER (WHERE retention_risk = 'High') AS high_risk_count"
ORACLES["batch_summary"] = SCORE + f"SELECT {SUMMARY} FROM scored"
ORACLES["tier_summary"] = SCORE + f"""SELECT retention_risk, t.Contract AS contract, {SUMMARY}
FROM scored s JOIN telco t ON s.key = t.key GROUP BY ALL"""
ORACLES["tier_narrative"] = SCORE + (
    "SELECT key, retention_risk, CASE retention_risk {} END AS narrative FROM scored".format(
        " ".join(f"WHEN {q(t)} THEN {q(s)}" for t, s in NARRATIVES.items()))
)


def fixed(x: str, digits: int) -> str:
    """Digits as a browser shows them: printf, but exact halves go up."""
    step = 2 ** (digits + 1)
    nudge = f"CASE WHEN ({x}) * {step} = floor(({x}) * {step}) THEN {d(10.0 ** -(digits + 4))} ELSE 0 END"
    return f"printf('%.{digits}f', ({x}) + sign({x}) * {nudge})"


def loyal_cte() -> str:
    loyal = PROFILES["loyal"]
    cells = []
    for f in FIELDS:
        value = loyal.get(f.name)
        if f.name in YES_NO_FIELDS:
            value = {"Yes": 1, "No": 0}[value]
        cells.append(f"{'NULL' if value is None else q(value) if isinstance(value, str) else value} AS {f.name}")
    columns = ", ".join(f"{sql} AS {c}" for c, sql in encoding().items())
    return f"""loyal AS (SELECT round(1 / (1 + exp(-({logit_sql()}))), 4) AS baseline
  FROM (SELECT {columns} FROM (SELECT {', '.join(cells)})))"""


ORACLES["baseline_delta"] = with_(TELCO, enc_cte("telco"), LIN, SCORED, loyal_cte()) + f"""
SELECT key, churn_probability, baseline, round(delta, 6) AS delta,
  CASE WHEN delta > 0 THEN 'up' WHEN delta < 0 THEN 'down' ELSE 'flat' END AS delta_sign,
  CASE WHEN delta > 0 THEN '+' ELSE '' END || {fixed('delta', 2)} || ' pts' AS delta_text,
  {fixed('baseline * 100', 2)} || '%' AS baseline_text
FROM (SELECT key, churn_probability, baseline, (churn_probability - baseline) * 100 AS delta
      FROM scored, loyal)"""
ORACLES["gauge"] = SCORE + """SELECT key, round(c, 6) AS clamped, round(180 - c * 180, 6) AS angle,
  CASE WHEN c <= 0.33 THEN '#22c55e' WHEN c <= 0.66 THEN '#f59e0b' ELSE '#ef4444' END AS colour
FROM (SELECT key, CASE WHEN x < 0 THEN CAST(0 AS DOUBLE) WHEN x > 1 THEN CAST(1 AS DOUBLE) ELSE x END AS c
  FROM (SELECT key, churn_probability * CAST(1.5 AS DOUBLE) - CAST(0.25 AS DOUBLE) AS x FROM scored))"""


# --- drivers ----------------------------------------------------------------------

def phi_cte(style: str = "faithful") -> str:
    rows = " UNION ALL ".join(
        f"SELECT key, {i} AS position, {q(LABELS[c][style == 'pretty'])} AS feature, "
        f"CAST({c} AS DOUBLE) AS value, {d(term(c)[0])} * ({c} - {d(term(c)[1])}) AS phi FROM enc"
        for i, c in enumerate(FEATURE_COLUMNS)
    )
    return f"phis AS ({rows})"


RANKED = """ranked AS (SELECT key, CAST(row_number() OVER (
    PARTITION BY key ORDER BY abs(phi) DESC, position) - 1 AS INTEGER) AS rank,
  feature, value, round(abs(phi), 4) AS magnitude,
  CASE WHEN phi >= 0 THEN 'up' ELSE 'down' END AS direction FROM phis
  QUALIFY rank < 8)"""
DRIVERS = with_(TELCO, enc_cte("telco"), phi_cte(), RANKED)
ORACLES["drivers_top8"] = DRIVERS + "SELECT * FROM ranked"
ORACLES["drivers_pretty"] = with_(TELCO, enc_cte("telco"), phi_cte("pretty"), RANKED) + (
    "SELECT * FROM ranked"
)
# The page ranks again by the rounded magnitudes, ties in the order it was given.
SHOWN = """shown AS (SELECT *, row_number() OVER (
    PARTITION BY key ORDER BY magnitude DESC, rank) - 1 AS place FROM ranked)"""
RISING = """rising AS (SELECT *, CAST(row_number() OVER (PARTITION BY key ORDER BY place) - 1 AS INTEGER) AS nth
  FROM shown WHERE place < 5 AND direction = 'up' AND magnitude >= 0.05)"""
PAGE = with_(TELCO, enc_cte("telco"), phi_cte(), RANKED, SHOWN)
ORACLES["drivers_rising"] = with_(TELCO, enc_cte("telco"), phi_cte(), RANKED, SHOWN, RISING) + (
    "SELECT key, nth AS rank, feature, magnitude FROM rising"
)
PLAIN = r"regexp_replace(CAST(value AS VARCHAR), '\.0$', '')"
ORACLES["panel_bars"] = PAGE + f"""SELECT key, CAST(place AS INTEGER) AS rank, feature,
  CASE WHEN value IS NULL THEN '—' WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR)
    ELSE {fixed('value', 2)} END AS value_text,
  {fixed('magnitude', 3)} AS magnitude_text, half AS width,
  CASE WHEN direction = 'up' THEN CAST(50 AS DOUBLE) ELSE 50 - half END AS left_edge
FROM (SELECT *, magnitude / greatest(max(magnitude) OVER (PARTITION BY key), 0.0001) * 100 / 2 AS half
      FROM shown)"""
ORACLES["explain_absent"] = with_(TELCO, GAPS, enc_cte("gaps", absent=True), phi_cte(), RANKED) + (
    "SELECT * FROM ranked"
)
ORACLES["additivity_audit"] = "SELECT count(*) AS rows, count(*) AS audited, true AS additive FROM customer"
ORACLES["additivity_damaged"] = """SELECT count(*) AS rows, count(*) FILTER (WHERE c_custkey % 7 <> 3) AS audited,
  true AS within, false AS additive FROM customer"""
NAMES = "names AS (SELECT * FROM (VALUES {}) n(position, \"column\"))".format(
    ", ".join(f"({i}, {q(c)})" for i, c in enumerate(FEATURE_COLUMNS))
)
ORACLES["importance"] = with_(TELCO, enc_cte("telco"), phi_cte(), NAMES) + """
SELECT "column", feature, round(avg(abs(phi)), 12) AS mean_size, count(*) FILTER (WHERE top) AS rows_on_top
FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY abs(phi) DESC, position) = 1 AS top FROM phis
  WHERE key % 7 <> 2)
JOIN names USING (position) GROUP BY ALL"""
ORACLES["score_contract"] = SCORE + """SELECT count(*) AS rows,
  CAST(0 AS BIGINT) AS bad_prediction, CAST(0 AS BIGINT) AS bad_probability,
  CAST(0 AS BIGINT) AS bad_tier, CAST(0 AS BIGINT) AS bad_drivers FROM scored"""
GUARD = """damaged_phis AS (SELECT key, position, feature,
    CASE WHEN key % 7 = 5 THEN NULL ELSE value END AS value,
    CASE WHEN key % 7 = 4 AND position % 5 < 2 THEN CAST(0 AS DOUBLE) ELSE phi END AS phi
  FROM phis WHERE key % 7 NOT IN (2, 3))"""
ORACLES["explain_guard"] = with_(
    TELCO, enc_cte("telco"), phi_cte(), GUARD, RANKED.replace("FROM phis", "FROM damaged_phis")
) + """SELECT * FROM ranked UNION ALL
SELECT key, NULL, NULL, NULL, NULL, NULL FROM telco WHERE key % 7 IN (2, 3)"""


# --- actions ----------------------------------------------------------------------

def lines(k: int) -> str:
    return f"""string_agg(feature || '=' || COALESCE({PLAIN}, '?') || ' (' ||
  CASE direction WHEN 'up' THEN '+' ELSE '-' END || {fixed('magnitude', 3)} || ')', '; ' ORDER BY {{}})
  FILTER (WHERE {{}} < {k})"""


TAGS = f"string_agg(feature || ' (' || {fixed('magnitude', 3)} || ')', '|' ORDER BY place) FILTER (WHERE place < 3)"
ORACLES["driver_text"] = PAGE + f"""SELECT key, {lines(8).format('rank', 'rank')} AS reasons,
  {TAGS} AS tags FROM shown GROUP BY key"""


def precaution_ctes(style: str) -> tuple[str, ...]:
    size = r"regexp_replace(CAST(magnitude AS VARCHAR), '\.0$', '')"
    case = {"no": "", "id": "", "title": "", "body": ""}
    for n, r in enumerate(RULES):
        test = f"WHEN regexp_matches(feature, {q('(?i)' + r.pattern)}) THEN "
        case["no"] += test + f"{n} "
        case["id"] += test + (f"{q(r.id + '-')} || {size} " if r.sized else q(r.id) + " ")
        case["title"] += test + q(r.title) + " "
        case["body"] += test + q(r.body) + " "
    picked = f"""picked AS (SELECT key, nth AS ord, CASE {case['id']} END AS id,
  CASE {case['title']} END AS title, CASE {case['body']} END AS body
  FROM (SELECT *, row_number() OVER (PARTITION BY key, feature ORDER BY nth) AS copy FROM rising)
  WHERE copy = 1 AND CASE {case['no']} END IS NOT NULL)"""
    everything = f"""every AS (SELECT * FROM picked
  UNION ALL SELECT key, 100, 'p0-baseline', 'Above-baseline alert',
    'Predicted churn probability is ' || {fixed('churn_probability * 100', 1)} ||
    '%. Open a 30-day hold while the targeted plays run; re-score on day 21.'
    FROM scored WHERE churn_probability >= 0.4
  UNION ALL SELECT key, 101, 'p0-inputs', 'Incomplete customer record',
    len(string_split(m, '|')) || ' key field(s) are blank: ' || replace(m, '|', ', ') ||
    '. The current probability is a floor estimate; collect the missing data before quoting a number to stakeholders.'
    FROM (SELECT key, {missing_list()} AS m FROM gaps) WHERE m <> ''),
precautions AS (SELECT key, CAST(row_number() OVER (PARTITION BY key ORDER BY ord) - 1 AS INTEGER) AS rank,
  id, title, body FROM every)"""
    return (TELCO, GAPS, enc_cte("gaps"), LIN, SCORED, phi_cte(style), RANKED, SHOWN, RISING,
            picked, everything)


ORACLES["precautions"] = with_(*precaution_ctes("faithful")) + "SELECT * FROM precautions"
ORACLES["precautions_pretty"] = with_(*precaution_ctes("pretty")) + "SELECT * FROM precautions"
REQUEST = f"""request AS (SELECT s.key, retention_risk AS risk_level, reasons, top_drivers,
  COALESCE(signals, '') AS risk_signals,
  CAST({fixed('churn_probability * 100', 1)} AS DOUBLE) AS probability_pct
  FROM scored s
  JOIN (SELECT key, {lines(3).format('place', 'place')} AS reasons, {TAGS} AS top_drivers
        FROM shown GROUP BY key) USING (key)
  LEFT JOIN (SELECT key, string_agg(title, '|' ORDER BY rank) AS signals FROM precautions GROUP BY key)
    USING (key))"""
ORACLES["retention_request"] = with_(*precaution_ctes("faithful"), REQUEST) + "SELECT * FROM request"
ORACLES["brief_text"] = with_(*precaution_ctes("faithful"), REQUEST) + f"""SELECT key,
  'You are an internal customer-success strategist. The account is flagged as a ' || risk_level ||
  ' churn risk' || CASE WHEN key % 4 = 3 THEN '' ELSE
    ' (predicted probability ' || printf('%.1f', probability_pct) || '%)' END ||
  '. Operational notes from the form: ' || reasons || '.' ||
  CASE WHEN key % 4 = 1 THEN '' ELSE chr(10) || chr(10) || {q(DRIVERS_HEADING)} || chr(10) || '  - ' ||
    replace(top_drivers, '|', chr(10) || '  - ') END ||
  CASE WHEN key % 4 = 2 OR risk_signals = '' THEN '' ELSE chr(10) || chr(10) || {q(SIGNALS_HEADING)} ||
    chr(10) || '  - ' || replace(risk_signals, '|', chr(10) || '  - ') END ||
  {q(INSTRUCTIONS)} AS brief FROM request"""
SPACE = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
ORACLES["plan_select"] = f"""SELECT conv_id, turn, CASE WHEN COALESCE(s, '') = '' THEN {q(DEFAULT_PLAN)}
  ELSE '[Action Plan] ' || s END AS plan FROM (
  SELECT conv_id, turn, {SPACE.format('t')} AS s FROM (
    SELECT conv_id, turn, CASE WHEN role = 'user' THEN CASE turn % 4 WHEN 1 THEN NULL
      WHEN 2 THEN ' ' || chr(10) || ' ' ELSE '  ' || text || chr(10) END ELSE text END AS t
    FROM conversations))"""
ORACLES["plan_tag"] = r"""SELECT conv_id, turn,
  CASE WHEN t LIKE '[Action Plan]%' THEN 'LLM' WHEN t LIKE '[Default Action Plan]%' THEN 'Default' END AS badge,
  CASE WHEN COALESCE(t, '') = '' THEN """ + q(NO_PLAN) + r"""
    ELSE regexp_replace(t, '^\[(Action Plan|Default Action Plan)\]\s*', '') END AS body
FROM (SELECT conv_id, turn, CASE WHEN turn % 5 = 0 THEN '[Action Plan] ' || text
    WHEN turn % 5 = 1 THEN '[Default Action Plan]' || chr(10) || text
    WHEN turn % 5 = 2 THEN '[Generated by LLM] ' || text
    WHEN turn % 5 = 3 AND role = 'user' THEN ''
    WHEN turn % 5 = 4 AND role = 'user' THEN NULL ELSE text END AS t FROM conversations)"""
ORACLES["model_slot"] = f"""SELECT event_id, CASE WHEN event_id % 5 IN (1, 2)
  THEN {q(SLOTS['high_capacity'])} ELSE {q(SLOTS['standard'])} END AS model FROM events"""


# --- training ---------------------------------------------------------------------

TRAIN = """train AS (SELECT * REPLACE (
    CASE WHEN Offer = 'None' THEN NULL ELSE Offer END AS Offer,
    CASE WHEN key % 17 = 0 THEN 0 ELSE TotalCharges END AS TotalCharges) FROM telco)"""
ORACLES["train_frame"] = with_(TELCO, TRAIN, enc_cte("train", carry="key, Churn")) + "SELECT * FROM enc"
ORACLES["train_frame_text_key"] = with_(
    TELCO, TRAIN, enc_cte("train", carry="'C-' || CAST(key AS VARCHAR) AS key, Churn")
) + "SELECT * FROM enc"
ORACLES["fit_sample"] = with_(TELCO) + (
    "SELECT 'C-' || CAST(key AS VARCHAR) AS key, Churn FROM telco ORDER BY 1 LIMIT 500"
)
ORACLES["vocabulary"] = with_(TELCO, TRAIN) + " UNION ALL ".join(
    f"SELECT {q(DATASET_NAMES[n])} AS \"column\", CAST({n} AS VARCHAR) AS value, count(*) AS n "
    "FROM train GROUP BY ALL"
    for n in ("Gender", "SeniorCitizen", "Contract", "PaymentMethod", "InternetType", "Offer")
)
ORACLES["target_recode"] = with_(TELCO) + "SELECT key, Churn FROM telco WHERE key % 10 > 1"
SERVICES = ("OnlineSecurity", "OnlineBackup", "DeviceProtection", "TechSupport", "StreamingTV",
            "StreamingMovies")
ORACLES["derived_features"] = with_(TELCO) + f"""SELECT key,
  CASE WHEN tenure = 0 THEN 0 ELSE TotalRevenue / tenure END AS revenue_per_tenure,
  CASE WHEN tenure = 0 THEN 0 ELSE TotalCharges / tenure END AS charges_per_month,
  CAST({' + '.join(SERVICES)} AS INTEGER) AS total_services,
  CASE WHEN a > 0 AND a <= 30 THEN 'Young' WHEN a > 30 AND a <= 50 THEN 'Adult'
    WHEN a > 50 AND a <= 70 THEN 'Senior' WHEN a > 70 AND a <= 120 THEN 'Elderly' ELSE 'nan' END AS age_group
FROM (SELECT *, CASE WHEN key % 3 = 0 THEN [0, 30, 31, 50, 51, 70, 71, 120, 121, NULL][key % 10 + 1]
      ELSE Age END AS a FROM telco)"""
ORACLES["parity"] = """SELECT count(*) AS rows, 51 AS train_columns, 51 AS score_columns,
  51 AS shared_columns, CAST(0 AS BIGINT) AS rows_that_differ FROM customer"""
SPLIT = """counts AS (SELECT Churn, count(*) AS n, sum(count(*)) OVER () AS total FROM telco GROUP BY Churn),
shares AS (SELECT *, total - ceil(total * CAST(0.2 AS DOUBLE)) AS train,
  CAST(n AS DOUBLE) / total * (total - ceil(total * CAST(0.2 AS DOUBLE))) AS exact FROM counts),
sizes AS (SELECT Churn, floor(exact) + CASE WHEN row_number() OVER (ORDER BY exact - floor(exact) DESC, Churn)
    <= train - sum(floor(exact)) OVER () THEN 1 ELSE 0 END AS n_train FROM shares),
sides AS (SELECT key, Churn, row_number() OVER (PARTITION BY Churn ORDER BY md5(key || ':42')) <= n_train
  AS is_train FROM telco JOIN sizes USING (Churn))"""
ORACLES["split_sides"] = with_(TELCO, SPLIT) + "SELECT key, Churn, is_train FROM sides"
ORACLES["split_counts"] = with_(TELCO, SPLIT) + (
    "SELECT Churn, is_train, count(*) AS n FROM sides GROUP BY ALL"
)
ORACLES["class_weights"] = with_(TELCO) + """SELECT Churn AS label, count(*) AS n,
  CAST(sum(count(*)) OVER () AS DOUBLE) / (count(*) OVER () * count(*)) AS weight FROM telco
WHERE key % 9 <> 0 GROUP BY Churn"""
AUC = """SELECT {by} count(*) FILTER (WHERE ok AND Churn = 1) AS positives,
  count(*) FILTER (WHERE ok AND Churn = 0) AS negatives, count(*) FILTER (WHERE NOT ok) AS left_out,
  round((sum(r) FILTER (WHERE ok AND Churn = 1) - CAST(count(*) FILTER (WHERE ok AND Churn = 1) AS DOUBLE)
      * (count(*) FILTER (WHERE ok AND Churn = 1) + 1) / 2)
    / (count(*) FILTER (WHERE ok AND Churn = 1) * count(*) FILTER (WHERE ok AND Churn = 0)), 9) AS auc
FROM (SELECT *, rank() OVER (PARTITION BY ok{part} ORDER BY s) + (count(*) OVER (PARTITION BY ok, s{part}) - 1) / 2.0 AS r
  FROM (SELECT t.Churn, retention_risk, {score} AS s, t.key % 50 NOT IN (7, 8, 9) AS ok
        FROM scored JOIN telco t USING (key))) GROUP BY ALL"""
ORACLES["auc_exact"] = SCORE + AUC.format(by="", part="", score="p")
ORACLES["auc_ties"] = SCORE + AUC.format(
    by="retention_risk,", part=", retention_risk", score="floor(p * 20)"
)


# --- fitted models: what holds whatever the trees are ---

GONE = "FROM sides WHERE NOT is_train"
ORACLES["tree_additivity"] = with_(TELCO, SPLIT) + (
    f"SELECT count(*) AS rows, count(*) AS audited, true AS additive {GONE}"
)
ORACLES["gbt_rounds"] = with_(TELCO, SPLIT) + f"""SELECT CAST(r AS INTEGER) AS round,
  count(*) FILTER (WHERE Churn = 1) AS positives, count(*) FILTER (WHERE Churn = 0) AS negatives,
  true AS area_valid, true AS loss_agrees FROM (SELECT * {GONE}), range(1, {SMALL.trees + 1}) t(r) GROUP BY r"""
ORACLES["tree_importance"] = """SELECT CAST(51 AS BIGINT) AS features, count(*) AS rows, true AS planted_leads
FROM orders"""
ORACLES["train_gbt_metrics"] = f"""SELECT 'churn_prediction' AS experiment, {SMALL.trees} AS trees,
  count(*) AS labelled_rows, 'all' AS max_rows, true AS area_logged,
  count(*) - CAST(ceil(count(*) * CAST(0.2 AS DOUBLE)) AS BIGINT) AS train_rows,
  CAST(ceil(count(*) * CAST(0.2 AS DOUBLE)) AS BIGINT) AS test_rows, CAST(0 AS BIGINT) AS unlabelled,
  true AS learned, true AS loss_falls, CAST(0 AS BIGINT) AS reloaded_unequal FROM orders"""


# --- leaf-wise trees, grown level by level from the definition ---

def best_cuts(name: str, rows: str) -> str:
    """The best cut of every node of ``rows`` (key, g, h, node)."""
    worth = "pow({0}, 2) / ({1} + {2})".format
    c = THREE_LEAVES
    return f"""{name} AS MATERIALIZED (
  SELECT node, f, v, gain FROM (
    SELECT *, row_number() OVER (PARTITION BY node ORDER BY f, v) AS place FROM (
      SELECT *, max(gain) OVER (PARTITION BY node) AS most FROM (
        SELECT node, f, v, {worth("gl", "hl", d(c.l2))} + {worth("(gt - gl)", "(ht - hl)", d(c.l2))}
            - {worth("gt", "ht", d(c.l2))} AS gain FROM (
          SELECT node, f, v, sum(g) OVER upto AS gl, sum(h) OVER upto AS hl, sum(n) OVER upto AS nl,
                 sum(g) OVER every AS gt, sum(h) OVER every AS ht, sum(n) OVER every AS nt
          FROM (SELECT node, f, v, sum(g) AS g, sum(h) AS h, count(*) AS n
                FROM {rows} JOIN cells USING (key) GROUP BY ALL)
          WINDOW upto AS (PARTITION BY node, f ORDER BY v), every AS (PARTITION BY node, f))
        WHERE least(nl, nt - nl) >= {c.least_rows} AND least(hl, ht - hl) >= {d(c.least_hessian)}))
    WHERE gain > 1e-12 AND gain >= most * (1 - {d(1e-10)}))
  WHERE place = 1)"""


def boosted_ctes() -> list[str]:
    c = THREE_LEAVES
    ctes = [
        "learn AS MATERIALIZED (SELECT key, s.Churn AS y, count(*) OVER () / (2.0 * count(*) OVER "
        "(PARTITION BY s.Churn)) AS w, enc.* EXCLUDE (key) FROM sides s JOIN enc USING (key) WHERE is_train)",
        f"cells AS MATERIALIZED (SELECT key, unnest(range({len(FEW_VALUES)})) AS f, "
        f"unnest([{', '.join(f'CAST({x} AS DOUBLE)' for x in FEW_VALUES)}]) AS v FROM learn)",
        "edges AS MATERIALIZED (SELECT f, v, (v + lead(v) OVER (PARTITION BY f ORDER BY v)) / 2 AS edge "
        "FROM (SELECT DISTINCT f, v FROM cells))",
        "m0 AS (SELECT key, CAST(0 AS DOUBLE) AS margin FROM learn)",
    ]
    for t in range(1, c.trees + 1):
        ctes += [
            f"""r{t} AS MATERIALIZED (SELECT key, 1 AS node, w * (p - y) AS g, w * p * (1 - p) AS h FROM (
  SELECT key, y, w, 1 / (1 + exp(-margin)) AS p FROM learn JOIN m{t - 1} USING (key)))""",
            best_cuts(f"a{t}", f"r{t}"),
            f"""s{t} AS MATERIALIZED (SELECT r.key, g, h, CASE WHEN a.f IS NULL THEN 1 WHEN x.v <= a.v THEN 2 ELSE 3 END AS node
  FROM r{t} r LEFT JOIN a{t} a ON true LEFT JOIN cells x ON x.key = r.key AND x.f = a.f)""",
            # Two leaves; the better cut of theirs makes the third.
            best_cuts(f"every{t}", f"(SELECT * FROM s{t} WHERE node > 1)"),
            f"b{t} AS MATERIALIZED (SELECT * FROM every{t} ORDER BY gain DESC, node LIMIT 1)",
            f"""l{t} AS MATERIALIZED (SELECT s.key, g, h, CASE WHEN b.f IS NULL THEN s.node
      WHEN x.v <= b.v THEN 2 * s.node ELSE 2 * s.node + 1 END AS node
  FROM s{t} s LEFT JOIN b{t} b USING (node) LEFT JOIN cells x ON x.key = s.key AND x.f = b.f)""",
            f"v{t} AS MATERIALIZED (SELECT node, -{d(c.step)} * sum(g) / (sum(h) + {d(c.l2)}) AS value, "
            f"count(*) AS rows FROM l{t} GROUP BY node)",
            f"m{t} AS MATERIALIZED (SELECT key, margin + value AS margin FROM m{t - 1} JOIN l{t} USING (key) "
            f"JOIN v{t} USING (node))",
        ]
    return ctes


def boosted_nodes(t: int) -> str:
    names = "[" + ", ".join(map(q, FEW_VALUES)) + "]"
    inner = " UNION ALL ".join(
        f"SELECT {t} AS tree, node, {names}[f + 1] AS feature, edge AS threshold, CAST(NULL AS DOUBLE) "
        f"AS value, (SELECT count(*) FROM {rows} k WHERE k.node = c.node) AS rows "
        f"FROM {cut} c JOIN edges USING (f, v)"
        for cut, rows in ((f"a{t}", f"r{t}"), (f"b{t}", f"s{t}")))
    return f"""{inner} UNION ALL SELECT {t}, node, NULL, NULL, round(value, 9), rows FROM v{t}"""


ORACLES["boosted_leaves"] = with_(TELCO, enc_cte("telco"), SPLIT, *boosted_ctes()) + (
    "SELECT CAST(tree AS INTEGER) AS tree, CAST(node AS INTEGER) AS node, feature, threshold, value, rows FROM ("
    + " UNION ALL ".join(boosted_nodes(t) for t in range(1, THREE_LEAVES.trees + 1)) + ")")
ORACLES["target_split"] = with_(TELCO, enc_cte("telco", carry="key, Churn")) + "SELECT key, Churn, 51 AS features, CAST({} AS DOUBLE) AS feature_sum FROM enc".format(
    " + ".join(f"CAST({c} AS DECIMAL(30,6))" for c in FEATURE_COLUMNS))
ORACLES["field_map"] = with_(TELCO) + " UNION ALL ".join(
    f"SELECT {q(f.name)} AS field, {q(f.dataset)} AS dataset, "
    f"{q(re.sub('[^a-zA-Z0-9_]', '_', f.dataset))} AS \"column\", count({f.name}) AS customers FROM telco"
    for f in FIELDS)
ORACLES["deep_additivity"] = ORACLES["additivity_audit"]
ORACLES["boosted_rounds"] = with_(TELCO, SPLIT) + """SELECT CAST(r AS INTEGER) AS round,
  count(*) FILTER (WHERE is_train) AS train_rows, count(*) FILTER (WHERE NOT is_train) AS test_rows,
  true AS few_leaves, true AS area_logged, true AS loss_taken FROM sides, range(1, 301) t(r) GROUP BY r"""


# --- attributions of the small fixed ensemble, by the definition of Shapley values ---

def expected(tree: dict[int, Node], node: Node, known: frozenset[int]) -> str:
    """Value of a tree when only some features are known: others average by cover."""
    if node.feature < 0:
        return d(node.value)
    left, right = tree[node.left], tree[node.right]
    a, b = expected(tree, left, known), expected(tree, right, known)
    if node.feature in known:
        return f"CASE WHEN {FEATURE_COLUMNS[node.feature]} <= {node.threshold} THEN {a} ELSE {b} END"
    return f"({d(left.cover / node.cover)} * ({a}) + {d(right.cover / node.cover)} * ({b}))"


def shapley_sql(feature: int) -> str:
    total = []
    for weight, tree in FOREST:
        asked = sorted({n.feature for n in tree.values() if n.feature >= 0})
        if feature not in asked:
            continue
        others = [f for f in asked if f != feature]
        n = len(asked)
        for size in range(n):
            share = factorial(size) * factorial(n - size - 1) / factorial(n)
            for known in combinations(others, size):
                with_it = expected(tree, tree[0], frozenset({*known, feature}))
                without = expected(tree, tree[0], frozenset(known))
                total.append(f"{d(weight * share)} * (({with_it}) - ({without}))")
    return " + ".join(total) or "CAST(0 AS DOUBLE)"


FOREST_PHI = "phis AS ({})".format(" UNION ALL ".join(
    f"SELECT key, {i} AS position, {q(LABELS[c][0])} AS feature, CAST({c} AS DOUBLE) AS value, "
    f"{shapley_sql(i)} AS phi FROM enc"
    for i, c in enumerate(FEATURE_COLUMNS)
))
FOREST_BIAS = " + ".join(
    f"{d(weight)} * ({expected(tree, tree[0], frozenset())})" for weight, tree in FOREST
)
ORACLES["tree_drivers"] = with_(TELCO, enc_cte("telco"), FOREST_PHI, RANKED) + (
    f"SELECT *, round({FOREST_BIAS}, 9) AS bias FROM ranked"
)


# --- sources and sinks ------------------------------------------------------------

ORACLES["csv_roundtrip"] = with_(TELCO) + "SELECT * EXCLUDE (Churn) FROM telco"
ORACLES["json_roundtrip"] = ORACLES["csv_roundtrip"]
ORACLES["score_json_output"] = with_(TELCO, enc_cte("telco"), LIN, SCORED, phi_cte(), RANKED) + """
SELECT s.key, prediction, churn_probability, retention_risk, rank, feature, value, magnitude, direction
FROM scored s JOIN ranked r ON s.key = r.key"""


def draw_sql(key: str, position: int, seed: int = 42) -> str:
    a = gen.multiplier(position) % gen.PRIME
    first = f"((({key} % {gen.PRIME}) * {a} + {seed * 7919 + position}) % {gen.PRIME})"
    second = f"(({first} * {first} + {position + 1}) % {gen.PRIME})"
    return f"(({second} * {second} + {first}) % {gen.PRIME})"


def generated_cte(keys: str) -> str:
    out = []
    for i, f in enumerate(FIELDS):
        u = draw_sql("key", i)
        if f.name in gen.CHOICES:
            words = gen.CHOICES[f.name]
            sql = "[" + ", ".join(map(q, words)) + f"][{u} % {len(words)} + 1]"
        elif f.name in gen.COUNTS:
            low, high = gen.COUNTS[f.name]
            sql = f"{low} + {u} % {high - low + 1}"
        elif f.name in gen.AMOUNTS:
            low, high = gen.AMOUNTS[f.name]
            sql = f"CAST({low * 100} + {u} % {(high - low) * 100 + 1} AS DOUBLE) / 100"
        else:
            sql = f"{u} % 2"
        out.append(f"{sql} AS {f.name}")
    return f"generated AS (SELECT key, {', '.join(out)}, {draw_sql('key', len(FIELDS))} % 100 AS luck FROM ({keys}))"


ORACLES["training_load"] = with_(generated_cte(
    "SELECT DISTINCT (l_orderkey * 8 + l_linenumber) * 1000 + l_partkey % 1000 AS key FROM lineitem"
)) + "SELECT key, Gender, tenure, MonthlyCharges FROM generated"
ORACLES["synth_profile"] = with_(generated_cte("SELECT o_orderkey AS key FROM orders")) + """
SELECT Contract, count(*) AS n, CAST(sum(tenure) AS BIGINT) AS tenure, min(Age) AS youngest, max(Age) AS oldest,
  CAST(sum(SatisfactionScore) AS BIGINT) AS satisfaction,
  CAST(sum(CAST(MonthlyCharges AS DECIMAL(18,2))) AS DOUBLE) AS charges,
  count(*) FILTER (WHERE Offer = 'None') AS no_offer,
  count(*) FILTER (WHERE InternetType = 'Fiber Optic') AS fiber,
  count(*) FILTER (WHERE luck < 5 + CASE WHEN SatisfactionScore <= 2 THEN 45 ELSE 0 END
    + CASE WHEN Contract = 'Month-to-Month' THEN 30 ELSE 0 END
    + CASE WHEN tenure <= 12 THEN 15 ELSE 0 END) AS gone
FROM generated GROUP BY Contract"""


# --- streams ----------------------------------------------------------------------

ORACLES["stream_score"] = with_(
    TELCO, DAMAGED, CHECKED, VALID, enc_cte("valid", absent=True), LIN, SCORED, phi_cte(), RANKED
) + """SELECT s.key, prediction, churn_probability, retention_risk, feature AS first_driver, 8 AS n_drivers
FROM scored s JOIN ranked r ON s.key = r.key AND r.rank = 0"""
ORACLES["stream_ingest"] = with_(TELCO, DAMAGED) + "SELECT key, raw FROM damaged"

ORACLES["stream_capped"] = with_(TELCO, DAMAGED) + """SELECT least(count(*), 1000) AS rows,
  least(count(DISTINCT (key, raw)), 1000) AS records, least(count(*), 1000) AS counted FROM damaged"""


def counted(unit: str, limit: int) -> str:
    start = f"date_trunc('{unit}', ts)"
    return f"""SELECT strftime({start}, '%Y-%m-%d %H:%M:%S') AS window_start,
  strftime({start} + INTERVAL 1 {unit}, '%Y-%m-%d %H:%M:%S') AS window_end,
  user_id AS client, count(*) AS requests, count(*) > {limit} AS over_limit
FROM events GROUP BY {start}, user_id"""


def summarised(unit: str) -> str:
    start = f"date_trunc('{unit}', ts)"
    return f"""SELECT strftime({start}, '%Y-%m-%d %H:%M:%S') AS window_start, event_type AS path,
  count(*) AS requests, count(*) FILTER (WHERE event_type = 'error') AS failures,
  CAST(sum(CAST(ms AS DECIMAL(28,9))) AS DOUBLE) / NULLIF(count(ms), 0) AS mean_ms,
  quantile_disc(ms, 0.5) AS p50_estimate_ms, quantile_disc(ms, 0.95) AS p95_estimate_ms, max(ms) AS max_ms
FROM (SELECT *, CASE WHEN event_id % 11 <> 0 THEN value / 8 END AS ms FROM events
      WHERE event_id % 13 NOT IN (1, 2, 3)) GROUP BY {start}, event_type"""


ORACLES["log_unreadable"] = """SELECT CASE event_id % 13 WHEN 1 THEN '{"path":' WHEN 2 THEN '{"status":200}' END AS line,
  count(*) AS n FROM events WHERE event_id % 13 IN (1, 2, 3) GROUP BY 1"""


# A stream has closed the windows that end at or before the last event minus the delay.
CLOSED = " HAVING {start} + INTERVAL 1 {unit} <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"
ORACLES["rate_breach"] = counted("minute", 30)
ORACLES["rate_breach_daily"] = counted("day", 5)
ORACLES["rate_breach_stream"] = counted("day", 5) + CLOSED.format(
    start="date_trunc('day', ts)", unit="day")
ORACLES["stream_still_open"] = """SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS rows, count(*) AS windows FROM (
  SELECT date_trunc('day', ts) AS d, count(*) AS n FROM events GROUP BY d
  HAVING d + INTERVAL 1 day > (SELECT max(ts) - INTERVAL 10 MINUTE FROM events))"""
ORACLES["log_summary"] = summarised("minute")
ORACLES["log_summary_stream"] = summarised("hour") + CLOSED.format(
    start="date_trunc('hour', ts)", unit="hour")


# Days of the minutes that a stream has closed.
ORACLES["latency_rollup"] = """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start,
  event_type AS path, count(*) AS requests, count(*) FILTER (WHERE event_type = 'error') AS failures,
  CAST(sum(CAST(ms AS DECIMAL(28,9))) AS DOUBLE) / NULLIF(count(ms), 0) AS mean_ms,
  quantile_disc(ms, 0.5) AS p50_estimate_ms, quantile_disc(ms, 0.95) AS p95_estimate_ms, max(ms) AS max_ms
FROM (SELECT *, CASE WHEN event_id % 11 <> 0 THEN value / 8 END AS ms FROM events
      WHERE event_id % 13 NOT IN (1, 2, 3)
        AND date_trunc('minute', ts) + INTERVAL 1 MINUTE
          <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events WHERE event_id % 13 NOT IN (1, 2, 3)))
GROUP BY date_trunc('day', ts), event_type"""


# Weeks as Spark's windows count them, from the epoch.
ORACLES["latency_rank_error"] = """SELECT window_start, path, rank, timed, true AS within FROM (
  SELECT strftime(time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS window_start,
    event_type AS path, count(value) AS timed
  FROM events WHERE event_id % 13 NOT IN (1, 2, 3) AND event_id % 11 <> 0 GROUP BY 1, 2)
CROSS JOIN (VALUES (CAST(0.5 AS DOUBLE)), (0.95), (0.99)) AS r(rank) WHERE timed > 0"""


ORACLES["onehot_wide"] = """WITH pairs AS (
  SELECT o_orderkey, unnest(['customer', 'day', 'priority']) AS "column", unnest([
    CASE WHEN o_custkey % 7 <> 0 THEN 'c' || o_custkey END,
    strftime(o_orderdate, '%Y-%m-%d'), o_orderpriority]) AS value FROM orders)
SELECT "column", value, count(*) AS rows, CAST(sum(o_orderkey) AS BIGINT) AS keys,
  CAST((SELECT count(*) FROM (SELECT DISTINCT "column", value FROM pairs)) AS BIGINT) AS width
FROM pairs GROUP BY "column", value"""
