"""From drivers to precautions and the request for a retention plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ebbtide.functions.numbers import plain_number, to_fixed
from ebbtide.functions.plans import once
from ebbtide.operators.explain import rising, top_drivers

PRECAUTION = "struct<id:string,title:string,body:string>"


@dataclass(frozen=True)
class Rule:
    """A precaution for drivers whose label matches; ``sized`` ids end in the magnitude."""

    pattern: str
    id: str
    title: str
    body: str
    sized: bool = False


# The rules in order; the first that matches a driver wins.
RULES: tuple[Rule, ...] = (
    Rule(
        "satisfaction", "satisfaction", "Satisfaction-recovery outreach",
        "Open a ticket within 24h. Senior CS rep calls the customer, acknowledges the recent "
        "friction, and offers a goodwill credit. Goal: lift Satisfaction Score from current to "
        "4 within 30 days.",
        sized=True,
    ),
    Rule(
        "tenure", "tenure", "Early-tenure retention play",
        "Enroll in a 90-day onboarding concierge. Pair with a curated walkthrough of premium "
        "features they have not yet tried; surface a 6-month price-lock to remove the renewal "
        "anxiety.",
        sized=True,
    ),
    Rule(
        "contract", "contract-mtm", "Contract migration incentive",
        "Offer a 12-month contract at the current price with a one-time bill credit, no "
        "early-termination fee. Avoid a hard upsell; the goal is locking the term, not the tier.",
    ),
    Rule(
        "tech support|premium support", "tech-support", "Premium support trial",
        "Grant 60 days of Premium Support at no charge. Highlight the 24/7 channel and "
        "remote-diagnostics benefit. Track adoption so the renewal conversation has a concrete "
        "success metric.",
    ),
    Rule(
        "monthly charge|pricing|total charge", "pricing", "Pricing review",
        "Run an account audit against the customer's actual usage. Present two lower-tier "
        "options with a side-by-side savings estimate; do not require a plan change, just make "
        "the choice visible.",
    ),
    Rule(
        "payment", "payment", "Payment-method migration",
        "Switch the customer to bank withdrawal or credit card autopay. Mail-check customers "
        "churn at a higher rate; offer a one-time $10 credit for completing the migration.",
    ),
    Rule(
        "internet type", "internet-type", "Service-fit review",
        "Fiber customers on Month-to-Month contracts churn most. Schedule a network-quality "
        "check; if the line is healthy, lead with the speed-upgrade story, not a discount.",
    ),
    Rule(
        "cltv", "cltv", "Lifetime-value flag",
        "Escalate to the retention specialist queue. CLTV-driven churn is the highest-impact "
        "cohort; route to a senior agent with a 5% discretionary budget.",
    ),
    Rule(
        "streaming|unlimited data", "streaming", "Bundle rebalance",
        "The customer is paying for streaming add-ons they may not use. Surface a 30-day usage "
        "summary; offer a leaner bundle that keeps the core connectivity and drops the unused "
        "media add-ons.",
    ),
)

ALERT_FROM = 0.4


def driver_text(features: Column) -> Column:
    """``feature=value (+0.123); ...`` in the given order; a missing value reads "?"."""
    lines = F.transform(features, lambda d: F.concat(
        d["feature"], F.lit("="),
        F.coalesce(plain_number(d["value"]), F.lit("?")),
        F.lit(" ("),
        F.when(d["direction"] == "up", "+").otherwise("-"),
        to_fixed(d["magnitude"], 3),
        F.lit(")"),
    ))
    return F.array_join(lines, "; ")


def driver_tags(features: Column) -> Column:
    """``feature (0.123)`` of the three largest drivers."""
    return F.transform(top_drivers(features, 3), lambda d: F.concat(
        d["feature"], F.lit(" ("), to_fixed(d["magnitude"], 3), F.lit(")")
    ))


def _precaution(id: Column, title: Column, body: Column) -> Column:
    return F.struct(id.alias("id"), title.alias("title"), body.alias("body"))


def _matched(driver: Column) -> Column:
    """The precaution of the first rule that matches the driver's label, or null.

    Nine fixed patterns over at most five drivers: a CASE per driver stays inside the
    row, where a rule table would need an explode, a join and a regrouping.
    """
    label = driver["feature"]
    found = F.lit(None).cast(PRECAUTION)
    for rule in reversed(RULES):
        id = F.lit(rule.id)
        if rule.sized:
            id = F.concat(id, F.lit("-"), plain_number(driver["magnitude"]))
        found = F.when(
            label.rlike(f"(?i){rule.pattern}"),
            _precaution(id, F.lit(rule.title), F.lit(rule.body)),
        ).otherwise(found)
    return found


def driver_precautions(features: Column) -> Column:
    """One precaution per distinct driver label, in driver order; a driver that no rule
    matches gives none."""
    up = rising(features)
    labels = F.transform(up, lambda d: d["feature"])
    first = F.filter(up, lambda d, i: F.array_position(labels, d["feature"]) == i + 1)
    return F.array_compact(F.transform(first, _matched))


def baseline_alert(p: Column) -> Column:
    """The alert for a (rounded) probability of 40 % and more."""
    body = F.concat(
        F.lit("Predicted churn probability is "), to_fixed(p * 100.0, 1),
        F.lit("%. Open a 30-day hold while the targeted plays run; re-score on day 21."),
    )
    return F.when(
        p >= ALERT_FROM, _precaution(F.lit("p0-baseline"), F.lit("Above-baseline alert"), body)
    )


def incomplete_alert(missing: Column) -> Column:
    """The caution for blank key inputs."""
    body = F.concat(
        F.size(missing).cast("string"), F.lit(" key field(s) are blank: "),
        F.array_join(missing, ", "),
        F.lit(". The current probability is a floor estimate; collect the missing data before "
              "quoting a number to stakeholders."),
    )
    return F.when(
        F.size(missing) > 0,
        _precaution(F.lit("p0-inputs"), F.lit("Incomplete customer record"), body),
    )


def precautions(p: Column, features: Column, missing: Column | None = None) -> Column:
    """Driver precautions, then the alert, then the caution; empty without a score."""
    none = F.array().cast(f"array<{PRECAUTION}>")
    extra = [baseline_alert(p)] + ([incomplete_alert(missing)] if missing is not None else [])
    full = F.concat(
        F.coalesce(driver_precautions(features), none), F.array_compact(F.array(*extra))
    )
    return F.when(p.isNull(), none).otherwise(full)


def with_precautions(scored: DataFrame, missing: str | None = None) -> DataFrame:
    listed = precautions(
        F.col("churn_probability"), F.col("feature_importance"),
        None if missing is None else F.col(missing),
    )
    return once(scored, {"precautions": listed})


def with_retention_request(df: DataFrame) -> DataFrame:
    """Add ``request`` to rows that carry a score, drivers and ``precautions``."""
    features = F.col("feature_importance")
    return df.withColumn("request", F.struct(
        F.col("retention_risk").alias("risk_level"),
        driver_text(top_drivers(features, 3)).alias("reasons"),
        driver_tags(features).alias("top_drivers"),
        F.transform("precautions", lambda x: x["title"]).alias("risk_signals"),
        to_fixed(F.col("churn_probability") * 100.0, 1).cast("double").alias("probability_pct"),
    ))
