"""From a raw record to the numeric feature frame, as one projection."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, types as T

from ebbtide.functions.labels import collisions
from ebbtide.functions.numbers import NUMBER_PATTERN, is_blank, parse_number
from ebbtide.functions.plans import quoted, text
from ebbtide.schema import (
    CATEGORIES,
    CHARGES_COLUMN,
    DATASET_NAMES,
    FEATURE_COLUMNS,
    NULL_SENTINELS,
    NULLABLE_CATEGORIES,
    SENIOR_COLUMN,
    one_hot_name,
    sanitise,
)

# How a null in a column counts: as "missing" (a category of its own, the way a
# batch is read) or as "absent" (the record never had the field, the way a single
# record is read). Both are decided per row, never from the other rows.
NULL_IS_MISSING, NULL_IS_ABSENT = "missing", "absent"


class EmptyFeatureFrame(ValueError):
    """Nothing to score: the record has no usable column."""


def rename_fields(df: DataFrame) -> DataFrame:
    """API names become dataset names, for those fields that are there."""
    return df.withColumnsRenamed(DATASET_NAMES)


def sanitise_columns(df: DataFrame) -> DataFrame:
    """Column names keep letters, digits and underscores; a clash is an error."""
    clash = collisions(df.columns)
    if clash:
        raise ValueError(f"column names collide once sanitised: {', '.join(clash)}")
    return df.toDF(*map(sanitise, df.columns))


def charges_number(ref: str, dtype: T.DataType, lenient: bool = False) -> str:
    """Total charges at scoring time: blank text is 0.0, other text must be a number."""
    if not isinstance(dtype, T.StringType):
        return f"cast({ref} AS double)"
    otherwise = "NULL"
    if not lenient:
        otherwise = f"cast(raise_error(concat('not a number in Total Charges: ', {ref})) AS double)"
    return (
        f"CASE WHEN {ref} IS NULL THEN NULL WHEN {is_blank(ref)} THEN 0D "
        f"WHEN {ref} RLIKE r'{NUMBER_PATTERN}' THEN try_cast({ref} AS double) "
        f"ELSE {otherwise} END"
    )


def _number(ref: str, dtype: T.DataType) -> str:
    """Any column as a number; null, NaN and unreadable text are 0."""
    if isinstance(dtype, T.BooleanType):
        return f"coalesce(cast({ref} AS int), 0)"
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return f"coalesce(nanvl({ref}, 0D), 0D)"
    if isinstance(dtype, T.NumericType):
        return f"coalesce({ref}, 0)"
    if isinstance(dtype, T.StringType):
        return f"coalesce(nanvl({parse_number(ref)}, 0D), 0D)"
    return "0D"


def _indicators(column: str, present: bool, null_means: str) -> list[str]:
    """Indicator columns of one categorical field; an unseen value sets none."""
    ref = quoted(column)
    tests: dict[str, str] = {
        one_hot_name(column, v): f"{ref} = {text(v)}" for v in CATEGORIES[column]
    }
    if column in NULLABLE_CATEGORIES:
        missing = f"{ref} IN ({', '.join(map(text, NULL_SENTINELS))})"
        if null_means == NULL_IS_MISSING:
            missing = f"{ref} IS NULL OR {missing}"
        tests[one_hot_name(column, None)] = missing
    return [
        f"coalesce(cast({test} AS int), 0) AS {name}" if present else f"0 AS {name}"
        for name, test in tests.items()
    ]


def _senior(present: bool, null_means: str) -> list[str]:
    """The 0/1 pair; anything but 0 and 1 counts as 0."""
    zero_name, one_name = (one_hot_name(SENIOR_COLUMN, v) for v in ("0", "1"))
    if not present:
        return [f"0 AS {zero_name}", f"0 AS {one_name}"]
    ref = quoted(SENIOR_COLUMN)
    one = f"coalesce(try_cast({ref} AS bigint) = 1, false)"
    zero = f"NOT {one}"
    if null_means == NULL_IS_ABSENT:
        zero += f" AND {ref} IS NOT NULL"
    return [f"cast({zero} AS int) AS {zero_name}", f"cast({one} AS int) AS {one_name}"]


def encode(
    df: DataFrame,
    carry: Sequence[str] = ("key",),
    null_means: str = NULL_IS_MISSING,
    lenient_charges: bool = False,
) -> DataFrame:
    """The scoring encoder: ``carry`` columns, numeric columns, indicators.

    The vocabulary is fixed, so the column set depends on the schema alone, never on
    the rows; the whole encoder is one narrow projection without a shuffle.
    """
    named = df.withColumnsRenamed({k: v for k, v in DATASET_NAMES.items() if k not in carry})
    types = {f.name: f.dataType for f in named.schema.fields}
    categorical = {*CATEGORIES, SENIOR_COLUMN}
    passing = [c for c in types if c not in carry and c not in categorical]
    clash = collisions([*carry, *passing])
    if clash:
        raise ValueError(f"column names collide once sanitised: {', '.join(clash)}")
    out = [quoted(c) for c in carry]
    for c in passing:
        ref, dtype = quoted(c), types[c]
        if c == CHARGES_COLUMN:
            ref, dtype = charges_number(ref, dtype, lenient_charges), T.DoubleType()
        out.append(f"{_number(ref, dtype)} AS {quoted(sanitise(c))}")
    for column in CATEGORIES:
        out += _indicators(column, column in types, null_means)
    return named.selectExpr(*out, *_senior(SENIOR_COLUMN in types, null_means))


@dataclass(frozen=True)
class AlignReport:
    """What alignment had to add (as 0) and to drop."""

    missing: tuple[str, ...] = ()
    extras: tuple[str, ...] = ()


def align(
    df: DataFrame,
    expected: Sequence[str] | None = FEATURE_COLUMNS,
    carry: Sequence[str] = ("key",),
) -> tuple[DataFrame, AlignReport]:
    """Bring an encoded frame to the model's columns, in the model's order."""
    if expected is None:
        return df, AlignReport()
    produced = [c for c in df.columns if c not in carry]
    if not produced and expected:
        raise EmptyFeatureFrame("the encoded frame has no columns; nothing can be scored")
    missing = tuple(c for c in expected if c not in produced)
    extras = tuple(sorted(set(produced) - set(expected)))
    columns = [f"0 AS {quoted(c)}" if c in missing else quoted(c) for c in expected]
    return df.selectExpr(*map(quoted, carry), *columns), AlignReport(missing, extras)


def features(
    df: DataFrame, carry: Sequence[str] = ("key",), null_means: str = NULL_IS_MISSING
) -> DataFrame:
    """Raw records to the aligned 51-column frame."""
    return align(encode(df, carry, null_means), FEATURE_COLUMNS, carry)[0]


def numeric_and_text_columns(df: DataFrame) -> tuple[list[str], list[str]]:
    """Column names by role: (numeric, categorical)."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return numeric, text


def split_target(
    df: DataFrame, target: str, carry: Iterable[str] = ("key",)
) -> tuple[DataFrame, DataFrame]:
    """Features and target; both keep the carried key, since rows have no position."""
    return df.drop(target), df.select(*carry, target)


