"""Texts: the brief a plan is written from, the plan itself, and its tag."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

# The wording of the brief.
INSTRUCTIONS = """

Produce an internal 'Executive Retention Strategy & Action Plan' for the customer success team. \
Strict requirements:
1. Output exactly 3 to 4 distinct, high-density bullet points. No more, no less.
2. Each bullet must name a concrete action the organization must take behind the scenes or offer \
strategically to secure the account (e.g., a discount, a contract migration, a \
satisfaction-recovery outreach, a tech-support trial, a payment-method migration, a bundle \
rebalance, a CLTV escalation).
3. Each bullet must be grounded in the strongest Tree-SHAP driver(s) above; reference the specific \
feature (SatisfactionScore, Tenure_in_Months, Contract_Month_to_Month, Monthly_Charge, CLTV, etc.) \
and the magnitude.
4. No greetings, no customer-facing dialogue, no 'Hello [Name]', no scripts to read aloud. The \
output is for internal analyst use only.
5. Each bullet is one to two sentences. Use imperative voice. No preamble, no closing summary, no \
markdown headings."""

DRIVERS_HEADING = "Top Tree-SHAP drivers (log-odds contribution, descending):"
SIGNALS_HEADING = "Customer-specific signals flagged for action:"

# The plan that stands in for a missing one.
DEFAULT_PLAN = """[Default Action Plan]
- Audit the customer's actual usage against the active plan tier; if utilization is below 40% \
prepare a same-day downgrade offer with a fixed-price 12-month hold to remove renewal anxiety.
- Open a satisfaction-recovery workflow: senior CSM outreach within 24h, acknowledge the recent \
friction, attach a one-time goodwill credit (5-10% of MRR), and define a 30-day satisfaction \
re-score target.
- Lock in tenure: pair any discount with a 6- or 12-month contract at the current price; waive \
early-termination fees for the first 60 days to remove the customer's switching cost.
- Migrate the customer off mailed check to autopay with a one-time $10 credit; route to a \
tech-support trial if internet-type churn is the primary driver."""

PLAN_PREFIX = "[Action Plan] "
NO_PLAN = "No action plan generated."
TAG_PATTERN = r"^\[(Action Plan|Default Action Plan)\]\s*"
BADGES = {"Action Plan": "LLM", "Default Action Plan": "Default"}


def _bullets(heading: str, items: Column) -> Column:
    lines = F.transform(items, lambda x: F.concat(F.lit("\n  - "), x))
    return F.when(F.size(items) > 0, F.concat(F.lit("\n\n" + heading), F.array_join(lines, "")))


def brief(request: Column) -> Column:
    """The brief for one request; evidence blocks only where there is evidence."""
    percent = request["probability_pct"]
    shown = F.when(
        percent.isNotNull(),
        F.concat(F.lit(" (predicted probability "), F.format_string("%.1f", percent), F.lit("%)")),
    )
    blank = F.lit("")
    return F.concat(
        F.lit("You are an internal customer-success strategist. The account is flagged as a "),
        request["risk_level"], F.lit(" churn risk"), F.coalesce(shown, blank),
        F.lit(". Operational notes from the form: "), request["reasons"], F.lit("."),
        F.coalesce(_bullets(DRIVERS_HEADING, request["top_drivers"]), blank),
        F.coalesce(_bullets(SIGNALS_HEADING, request["risk_signals"]), blank),
        F.lit(INSTRUCTIONS),
    )


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def plan(generated: Column) -> Column:
    """The generated text under its tag, or the default plan where there is none."""
    text = _stripped(generated)
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(DEFAULT_PLAN)).otherwise(
        F.concat(F.lit(PLAN_PREFIX), text)
    )


def plan_badge(text: Column) -> Column:
    """LLM, Default, or null for a text without a known tag."""
    tag = F.regexp_extract(text, TAG_PATTERN, 1)
    badge = F.lit(None).cast("string")
    for name, label in BADGES.items():
        badge = F.when(tag == name, F.lit(label)).otherwise(badge)
    return badge


def plan_body(text: Column) -> Column:
    """The text without its tag."""
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(NO_PLAN)).otherwise(
        F.regexp_replace(text, TAG_PATTERN, "")
    )


def choose_slot(requested: Column, slots: Mapping[str, str], default: str) -> Column:
    """The text model behind the requested slot; the default one if it is unknown."""
    chosen = F.lit(slots[default])
    for name, model in slots.items():
        chosen = F.when(_stripped(requested) == name, F.lit(model)).otherwise(chosen)
    return chosen
