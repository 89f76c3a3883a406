"""Help for plans with wide or costly expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are computed exactly once per row.

    A filter on a projected column is pushed below the projection together with the
    column's definition, so a costly column (a parse, a model score, a ranking) would be
    computed in the filter, once per mention, and again for the result. Nothing is pushed
    through the generator used here: it re-emits the finished columns of a compiled
    projection, and what comes after sees plain columns.
    """
    kept = [quoted(c) for c in df.columns if c not in columns]
    computed = df.select(
        *[F.col(c) for c in kept], *[c.alias(f"_once_{n}") for n, c in columns.items()]
    )
    made = ", ".join(f"{quoted(f'_once_{n}')} AS {quoted(n)}" for n in columns)
    return computed.selectExpr(*kept, f"inline_outer(array(struct({made})))")


def quoted(name: str) -> str:
    """A column name in SQL text. Wide projections are written as SQL text, which costs
    one call to the JVM per column instead of one per function."""
    return "`" + name.replace("`", "``") + "`"


def text(value: str) -> str:
    """A string literal in SQL text."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def double(value: float) -> str:
    """A double literal in SQL text."""
    return f"({value!r}D)"
