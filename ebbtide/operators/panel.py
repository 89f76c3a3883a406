"""The numbers and texts a results page shows, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ebbtide.functions.numbers import to_fixed
from ebbtide.operators.explain import by_size

# Gauge colours by probability; they differ from the tier limits.
GAUGE_BANDS = ((0.33, "#22c55e"), (0.66, "#f59e0b"))
GAUGE_TOP = "#ef4444"
SMALLEST_SCALE = 0.0001

# The sentence shown with each tier.
NARRATIVES = {
    "High": "This customer shows multiple high-impact churn signals. Immediate intervention is "
            "recommended.",
    "Medium": "This customer is at moderate risk. Consider a proactive outreach with incentives.",
    "Low": "This customer is unlikely to churn under current conditions. Maintain standard "
           "engagement.",
}


def clamp(p: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))


def gauge_angle(p: Column) -> Column:
    """180 degrees at 0, 0 degrees at 1."""
    return F.lit(180.0) - clamp(p) * 180.0


def gauge_colour(p: Column) -> Column:
    c = clamp(p)
    colour = F.lit(GAUGE_TOP)
    for limit, name in reversed(GAUGE_BANDS):
        colour = F.when(c <= limit, F.lit(name)).otherwise(colour)
    return colour


def narrative(tier: Column) -> Column:
    text = F.lit(NARRATIVES["Low"])
    for name in ("Medium", "High"):
        text = F.when(tier == name, F.lit(NARRATIVES[name])).otherwise(text)
    return text


def scale(features: Column) -> Column:
    """The largest magnitude of a record, never below a small floor."""
    sizes = F.transform(features, lambda d: F.abs(d["magnitude"]))
    return F.greatest(F.array_max(sizes), F.lit(SMALLEST_SCALE))


def value_text(value: Column) -> Column:
    """A dash for no value, whole numbers as they are, others with two digits."""
    return (
        F.when(value.isNull(), F.lit("—"))
        .when(value == F.floor(value), value.cast("decimal(38,0)").cast("string"))
        .otherwise(to_fixed(value, 2))
    )


def bars(features: Column) -> Column:
    """One bar per driver by size: width and left edge in percent of the lane, whose
    middle is zero."""
    top = scale(features)

    def bar(d: Column) -> Column:
        half = F.abs(d["magnitude"]) / top * 100.0 / 2.0
        return F.struct(
            d["feature"].alias("feature"),
            value_text(d["value"]).alias("value_text"),
            to_fixed(d["magnitude"], 3).alias("magnitude_text"),
            half.alias("width"),
            F.when(d["direction"] == "up", F.lit(50.0)).otherwise(50.0 - half).alias("left_edge"),
        )

    return F.transform(by_size(features), bar)


def delta_points(p: Column, baseline: Column) -> Column:
    """Distance to the baseline in points; a baseline of 0 counts as none."""
    return F.when(baseline != 0, (p - baseline) * 100.0)


def delta_sign(delta: Column) -> Column:
    return F.when(delta > 0, "up").when(delta < 0, "down").when(delta == 0, "flat")


def delta_text(delta: Column) -> Column:
    plus = F.when(delta > 0, F.lit("+")).otherwise(F.lit(""))
    return F.concat(plus, to_fixed(delta, 2), F.lit(" pts"))


def with_baseline(scored: DataFrame, baseline: DataFrame) -> DataFrame:
    """Compare every score with the one ``churn_probability`` in ``baseline``.

    The baseline is read as a scalar subquery, so no join of any kind is planned, and
    a baseline of more than one row is an error.
    """
    value = baseline.select("churn_probability").scalar()
    compared = scored.withColumn("baseline", value)
    delta = delta_points(F.col("churn_probability"), F.col("baseline"))
    return compared.withColumn("delta", delta).withColumns({
        "delta_sign": delta_sign(F.col("delta")),
        "delta_text": delta_text(F.col("delta")),
        "baseline_text": F.concat(to_fixed(F.col("baseline") * 100.0, 2), F.lit("%")),
    })
