"""Display names of feature columns."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from ebbtide.schema import (
    CATEGORIES, COUNT, FIELDS, MONEY, SENIOR_COLUMN, Field, one_hot_name, sanitise,
)

FAITHFUL, PRETTY = "faithful", "pretty"

# Indicators of tables with the API spellings, as in PaymentMethod_Other: field and category.
_INDICATOR = re.compile(r"([^_]*)_(.*)", re.DOTALL)


def _in_words(field: Field) -> str:
    """The API name of a field in words: the dataset's spelling if both have the same letters,
    otherwise cut where a capital or a number begins."""
    if field.dataset.replace(" ", "").lower() == field.name.lower():
        return field.dataset
    return re.sub(r"(?<=[a-z])(?=[A-Z0-9])", " ", field.name)


#: Fields that may be indicators, and categories by their sanitised spelling.
_FIELDS = {f.name: _in_words(f) for f in FIELDS if f.kind not in (COUNT, MONEY)}
_CATEGORIES = {sanitise(v): v for values in CATEGORIES.values() for v in values}


def _known(style: str) -> dict[str, str]:
    """The label of every column that comes from a field, by what the field says.

    A field that is one column has its API name. An indicator shows its field and its
    category: the dashboards put the colon after the field's first word ("Internet: Type
    DSL"). Pretty labels put it after the whole name, and spell every name as the dataset
    does.
    """
    pretty = style == PRETTY
    labels = {f.column: f.dataset if pretty else f.name for f in FIELDS}
    for field, values in {**CATEGORIES, SENIOR_COLUMN: ("0", "1")}.items():
        shown = [field] if pretty else field.split(" ", 1)
        for value in (*values, None):
            rest = [*shown[1:], "null" if value is None else value]
            labels[one_hot_name(field, value)] = f"{shown[0]}: {' '.join(rest)}"
    return labels


def label_feature(column: str, style: str = FAITHFUL) -> str:
    """Display name of a feature column. Column names are metadata, so labels are made
    once while a plan is built and enter it as constants. Indicators of other models show
    field and category, other columns their name."""
    known = _known(style)
    if column in known or not (parts := _INDICATOR.fullmatch(column)):
        return known.get(column, column)
    field, category = parts.groups()
    shown = _CATEGORIES.get(category) or category.translate({ord("_"): " "}).strip()
    return f"{_FIELDS.get(field, field)}: {shown}"


def label_array(columns: Sequence[str], style: str = FAITHFUL) -> Column:
    return F.array(*[F.lit(label_feature(c, style)) for c in columns])


def collisions(names: list[str]) -> list[str]:
    """Names that become the same once sanitised."""
    seen: dict[str, list[str]] = {}
    for name in names:
        seen.setdefault(sanitise(name), []).append(name)
    return sorted(n for group in seen.values() if len(group) > 1 for n in group)
