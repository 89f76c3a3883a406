"""Row-wise validation: every rule adds a tag, no rule stops the job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ebbtide.functions.numbers import parse_number
from ebbtide.functions.plans import once, quoted, text
from ebbtide.schema import (
    BY_NAME, CATEGORY, COUNT, FIELD_NAMES, FIELDS, FLAG, MONEY, SENIOR,
)

MALFORMED = "record:malformed"
PARSED = "parsed_record"
NOT_AN_OBJECT = "record:not an object"
SATISFACTION_RANGE = (1, 5)


class EmptyBatch(ValueError):
    """A batch without any record."""


def require_rows(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise EmptyBatch("the batch is empty")
    return df


# Field kind -> (types a JSON value may have, message otherwise).
TYPE_RULES = {
    CATEGORY: ("STRING", "text required"),
    MONEY: (r"BIGINT|DOUBLE|FLOAT|DECIMAL\(\d+,\d+\)", "number required"),
    COUNT: ("BIGINT", "integer required"),
    FLAG: ("BIGINT", "integer required"),
    SENIOR: ("BIGINT", "integer required"),
}


def _clean_shape() -> str:
    """A pattern for the schema text of a record without any type error: known fields
    only (a variant lists them by name), each null or of an allowed type."""
    fields = sorted(FIELDS, key=lambda f: f.name)
    parts = "".join(rf"(?:{f.name}: (?:VOID|{TYPE_RULES[f.kind][0]})(?:, |>))?" for f in fields)
    return f"^OBJECT<{parts}>?$"


def _non_finite_fields(raw: Column) -> Column:
    """Fields whose JSON token is NaN or an infinity, in records that strict JSON
    cannot read for that reason."""
    loose = F.from_json(raw, T.MapType(T.StringType(), T.StringType()))
    bad = F.map_filter(loose, lambda _, v: F.replace(v, F.lit('"'), F.lit("")).isin(
        "NaN", "Infinity", "-Infinity"
    ))
    return F.transform(F.map_keys(bad), lambda k: F.concat(k, F.lit(":not finite")))


def check_records(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Strict reading of JSON records: adds ``errors`` and the parsed record.

    Types are compared before anything is cast, so 1.5 or "1" in an integer field is
    an error and not a silent null. Unknown fields are errors, too.
    """
    raw_text = F.col(raw)
    parsed = once(df, {"_v": F.try_parse_json(raw_text)})
    shaped = once(parsed, {"_shape": F.schema_of_variant("_v")})
    tags = []
    for f in FIELDS:
        allowed, message = TYPE_RULES[f.kind]
        found = f"schema_of_variant(try_variant_get(_v, '$.{f.name}', 'variant'))"
        tags.append(
            f"CASE WHEN NOT {found} RLIKE r'^(?:VOID|{allowed})$' THEN '{f.name}:{message}' END"
        )
    known = ", ".join(map(text, FIELD_NAMES))
    unknown = (
        f"transform(array_except(json_object_keys({quoted(raw)}), array({known})), "
        "k -> concat(k, ':unknown field'))"
    )
    # Unreadable as strict JSON: either a non-finite number literal or just broken.
    literal = F.coalesce(_non_finite_fields(raw_text), F.array().cast("array<string>"))
    unreadable = F.when(F.size(literal) > 0, literal).otherwise(F.array(F.lit(MALFORMED)))
    # Most records are fine, and one match on the schema text says so; the rules run
    # field by field only where it does not.
    errors = (
        F.when(F.col("_v").isNull(), unreadable)
        .when(F.col("_shape").rlike(_clean_shape()), F.array().cast("array<string>"))
        .when(~F.col("_shape").startswith("OBJECT<"), F.array(F.lit(NOT_AN_OBJECT)))
        .otherwise(F.expr(f"concat(array_compact(array({', '.join(tags)})), {unknown})"))
    )
    return once(shaped, {"errors": errors}).drop("_shape").withColumnRenamed("_v", PARSED)


def valid_records(checked: DataFrame, *carry: str) -> DataFrame:
    """The records without errors, one typed column per field, from what was parsed to
    check them: the whole record is read once, not field by field."""
    fine = checked.filter(F.size("errors") == 0)
    record = ", ".join(f"{f.name}: {f.spark_type.simpleString()}" for f in FIELDS)
    return fine.selectExpr(
        *map(quoted, carry), f"inline(array(variant_get({PARSED}, '$', 'struct<{record}>')))")


def quarantine(checked: DataFrame, *carry: str) -> DataFrame:
    """The rejected records with the reasons."""
    return checked.filter(F.size("errors") > 0).select(*carry, "errors")


def _range_tags(name: str, is_text: bool) -> list[str]:
    """SQL for the tags of one numeric field; a tag is null where its rule holds."""
    kind = BY_NAME[name].kind
    number = f"({parse_number(name)})" if is_text else f"cast({name} AS double)"
    infinite = "(double('inf'), double('-inf'), double('nan'))"

    def tag(broken: str, message: str) -> str:
        return f"CASE WHEN {broken} THEN '{name}:{message}' END"

    readable = f"{number} NOT IN {infinite}"
    tags = [tag(f"{name} IS NOT NULL AND NOT coalesce({readable}, false)", "not a number")]
    if kind in (FLAG, SENIOR, COUNT):
        tags.append(tag(f"{readable} AND {number} != floor({number})", "not an integer"))
    if kind in (FLAG, SENIOR):
        tags.append(tag(f"{readable} AND {number} NOT BETWEEN 0 AND 1", "not 0 or 1"))
    elif name == "SatisfactionScore":
        low, high = SATISFACTION_RANGE
        tags.append(tag(
            f"{readable} AND {number} NOT BETWEEN {low} AND {high}", f"not in {low}..{high}"
        ))
    else:
        tags.append(tag(f"{readable} AND {number} < 0", "negative"))
    return tags


def check_ranges(df: DataFrame) -> DataFrame:
    """Form rules: text is read as a number first, then the range of its field is
    checked. Adds ``errors``; null always passes."""
    types = {f.name: f.dataType for f in df.schema.fields}
    tags = []
    for f in FIELDS:
        if f.kind != CATEGORY and f.name in types:
            tags += _range_tags(f.name, isinstance(types[f.name], T.StringType))
    errors = f"array_compact(array({', '.join(tags)}))" if tags else "cast(array() AS array<string>)"
    return once(df, {"errors": F.expr(errors)})


def as_numbers(df: DataFrame) -> DataFrame:
    """Form text to typed columns; run after :func:`check_ranges`."""
    types = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for c in df.columns:
        f = BY_NAME.get(c)
        if f is None or f.kind == CATEGORY or not isinstance(types[c], T.StringType):
            out.append(quoted(c))
        else:
            out.append(f"try_cast({parse_number(c)} AS {f.spark_type.simpleString()}) AS {c}")
    return df.selectExpr(*out)


# The score record: its columns, their types and the values they may take.
SCORE_TYPES = {
    "prediction": T.IntegerType(),
    "churn_probability": T.DoubleType(),
    "retention_risk": T.StringType(),
}
TIERS = ("High", "Medium", "Low")


class BrokenScoreContract(ValueError):
    """A scored table lacks a column of the score record or has it in another type."""


def score_violations(scored: DataFrame) -> DataFrame:
    """One row of counts over all scored rows; all zero when the contract holds."""
    for name, dtype in SCORE_TYPES.items():
        if name not in scored.columns or scored.schema[name].dataType != dtype:
            raise BrokenScoreContract(f"{name} must be {dtype.simpleString()}")
    p = F.col("churn_probability")
    counts = {
        "rows": F.count("*"),
        "bad_prediction": F.count_if(~F.coalesce(F.col("prediction").isin(0, 1), F.lit(False))),
        "bad_probability": F.count_if(~F.coalesce((p >= 0) & (p <= 1), F.lit(False))),
        "bad_tier": F.count_if(~F.coalesce(F.col("retention_risk").isin(*TIERS), F.lit(False))),
    }
    if "feature_importance" in scored.columns:
        bad = F.exists("feature_importance", lambda d: (
            d["feature"].isNull() | d["magnitude"].isNull() | (d["magnitude"] < 0)
            | ~F.coalesce(d["direction"].isin("up", "down"), F.lit(False))
        ))
        counts["bad_drivers"] = F.count_if(F.coalesce(bad, F.lit(False)))
    return scored.agg(*[c.alias(n) for n, c in counts.items()])
