"""Driver records from per-feature contributions, for every row at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ebbtide.functions.labels import FAITHFUL, label_array, label_feature
from ebbtide.functions.numbers import is_finite, round_half_even
from ebbtide.functions.plans import once, quoted
from ebbtide.schema import DEFAULT_TOP_K, DRIVER_TYPE, FEATURE_COLUMNS


def _ranked(phi: str, n: int, top_k: int) -> str:
    """SQL for the ``top_k`` (order, position) pairs of a contribution array.

    n contributions, or n and a bias; any other width is null. Entries that are not
    finite count as 0. The key (-size, position) makes a plain array sort stable.
    """
    sizes = f"transform(slice({phi}, 1, {n}), x -> if(abs(x) < double('inf'), -abs(x), 0D))"
    pairs = (f"cast(arrays_zip({sizes}, sequence(0, {n - 1})) "
             "AS array<struct<order:double,position:int>>)")
    return f"CASE WHEN size({phi}) IN ({n}, {n + 1}) THEN slice(sort_array({pairs}), 1, {top_k}) END"


def with_drivers(
    explained: DataFrame,
    columns: Sequence[str] = FEATURE_COLUMNS,
    top_k: int = DEFAULT_TOP_K,
    style: str = FAITHFUL,
    phi: str = "phi",
    values: str = "feature_values",
) -> DataFrame:
    """Add ``feature_importance``: the ``top_k`` contributions by size, ties in column
    order. It is null where there is nothing to explain, so a score never fails for want
    of an explanation."""
    if top_k <= 0 or not columns:
        return without_drivers(explained)
    n = len(columns)
    k = min(top_k, n)
    ranked = once(explained, {"_ranked": F.expr(_ranked(quoted(phi), n, k))})
    labels = label_array(columns, style)

    def record(pair: Column) -> Column:
        position = pair["position"]
        value = F.get(F.col(values), position)
        contribution = F.get(F.col(phi), position)
        falls = (contribution < 0) & is_finite(contribution)
        return F.struct(
            F.get(labels, position).alias("feature"),
            F.when(~F.isnan(value), value).alias("value"),
            round_half_even(-pair["order"], 4).alias("magnitude"),
            F.when(falls, "down").otherwise("up").alias("direction"),
        )

    listed = F.transform("_ranked", record)
    return once(ranked, {"feature_importance": listed}).drop("_ranked")


def without_drivers(scored: DataFrame) -> DataFrame:
    """A score that carries no explanation."""
    kind = "array<" + DRIVER_TYPE.simpleString() + ">"
    return scored.withColumn("feature_importance", F.lit(None).cast(kind))


def by_size(features: Column) -> Column:
    """All drivers by size, ties in their given order."""
    keyed = F.transform(features, lambda d, i: F.struct(
        (-F.abs(d["magnitude"])).alias("order"), i.alias("position"), d.alias("driver")
    ))
    return F.transform(F.sort_array(keyed), lambda x: x["driver"])


def top_drivers(features: Column, k: int = 3) -> Column:
    """The first k of :func:`by_size`; no drivers is an empty list."""
    empty = F.array().cast("array<" + DRIVER_TYPE.simpleString() + ">")
    return F.coalesce(F.slice(by_size(features), 1, k), empty)


def rising(features: Column, k: int = 5, at_least: float = 0.05) -> Column:
    """Of the top k, the drivers that push towards churn and weigh something."""
    return F.filter(
        top_drivers(features, k),
        lambda d: (d["direction"] == "up") & (d["magnitude"] >= at_least),
    )


def residual(phi: Column, bias: Column, logit: Column) -> Column:
    """How far contributions plus bias are from the logit."""
    total = F.aggregate(phi, F.lit(0.0), lambda acc, x: acc + x)
    return F.abs(total + bias - logit)


def additivity_audit(
    explained: DataFrame, limit: float = 1e-6, margin: str = "logit"
) -> DataFrame:
    """One row over all scored rows: how many could be audited, the largest residual
    against the margin, and whether all were audited and are within the limit.

    The margin and not the probability is compared: a probability of 0 or 1 has no
    log-odds. A row without contributions, or with a null among them, is not audited."""
    off = residual(F.col("phi"), F.col("bias"), F.col(margin))
    found = explained.agg(
        F.count("*").alias("rows"),
        F.count_if(off.isNotNull() & ~F.isnan(off)).alias("audited"),
        F.coalesce(F.max(F.when(~F.isnan(off), off)), F.lit(0.0)).alias("worst"),
    )
    whole = (F.col("worst") < limit) & (F.col("audited") == F.col("rows"))
    return found.select("rows", "audited", "worst", whole.alias("additive"))


def importance(
    explained: DataFrame, columns: Sequence[str] = FEATURE_COLUMNS, style: str = FAITHFUL
) -> DataFrame:
    """Mean size of every feature's contribution over the explained rows, and in how many
    of them it is the largest one.

    A row whose array has another width explains nothing and is left out. The arrays are
    unpivoted inside the task and pre-aggregated there: one row per feature is shuffled."""
    n = len(columns)
    fit = explained.filter(f"size(phi) IN ({n}, {n + 1})")
    sizes = f"transform(slice(phi, 1, {n}), x -> if(abs(x) < double('inf'), abs(x), 0D))"
    sized = once(fit.select("phi"), {"sizes": F.expr(sizes)})
    placed = once(sized, {"top": F.expr("array_position(sizes, array_max(sizes)) - 1")})
    each = placed.select("top", F.posexplode("sizes").alias("position", "size"))
    means = each.groupBy("position").agg(
        F.avg("size").alias("mean_size"), F.count_if(F.col("top") == F.col("position")).alias("rows_on_top")
    )
    listed = F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(label_feature(c, style)).alias("feature"))
        for c in columns
    ])
    return means.select(F.get(listed, F.col("position")).alias("name"), "mean_size", "rows_on_top").select(
        "name.column", "name.feature", "mean_size", "rows_on_top")
