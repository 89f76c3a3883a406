"""Yes/No fields and blank fields."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from ebbtide.schema import FIELD_NAMES, KEY_INPUTS, YES_NO_FIELDS


def _flag_text(value: Column) -> Column:
    """The value as text; a number that is whole loses its fraction, a text stays."""
    text = value.cast("string")
    fractional = F.typeof(value).rlike("^(double|float|decimal)")
    return F.when(fractional, F.regexp_replace(text, r"\.0+$", "")).otherwise(text)


def to_binary(value: Column) -> Column:
    """Yes/1/"1" is 1, No/0/"0" is 0, anything else is null."""
    text = _flag_text(value)
    return F.when(text.isin("Yes", "1"), F.lit(1)).when(text.isin("No", "0"), F.lit(0))


def to_yes_no(value: Column) -> Column:
    """1/Yes is "Yes", 0/No is "No", anything else is the empty placeholder."""
    text = _flag_text(value)
    return (
        F.when(text.isin("Yes", "1"), F.lit("Yes"))
        .when(text.isin("No", "0"), F.lit("No"))
        .otherwise(F.lit(""))
    )


def normalise_flags(df: DataFrame) -> DataFrame:
    """Turn every Yes/No field into 0/1/null and pass the others through."""
    return df.select(*[
        to_binary(F.col(f"`{c}`")).alias(c) if c in YES_NO_FIELDS else F.col(f"`{c}`")
        for c in df.columns
    ])


def blanks_to_null(df: DataFrame, fields: Iterable[str] = FIELD_NAMES) -> DataFrame:
    """An empty text is no value."""
    text = {name for name, kind in df.dtypes if kind == "string"} & set(fields)
    return df.select(*[
        F.nullif(F.col(f"`{c}`"), F.lit("")).alias(c) if c in text else F.col(f"`{c}`")
        for c in df.columns
    ])


def missing_inputs(df: DataFrame) -> Column:
    """Names of the key inputs that are blank; a field not in the table is blank, too."""
    def blank(name: str) -> Column:
        if name not in df.columns:
            return F.lit(True)
        value = F.col(f"`{name}`")
        return value.isNull() | (value.cast("string") == "")

    return F.array_compact(F.array(*[F.when(blank(n), F.lit(n)) for n in KEY_INPUTS]))
