"""Optional derived features, kept apart from the 51-column contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ebbtide.functions.plans import quoted

# A column is a service if its name contains one of these.
SERVICE_MARKS = ("Security", "Backup", "Protection", "Tech Support", "Streaming")
# Right-closed age groups above 0; everything else reads "nan".
AGE_GROUPS = ((30, "Young"), (50, "Adult"), (70, "Senior"), (120, "Elderly"))


def per_month(amount: Column, months: Column) -> Column:
    """Amount per month; 0 in the first month. A missing amount stays missing."""
    return F.when(months == 0, F.lit(0.0)).otherwise(
        F.try_divide(amount.cast("double"), months.cast("double"))
    )


def age_group(age: Column) -> Column:
    group = F.when(age.isNull() | (age <= 0), F.lit("nan"))
    for upper, name in AGE_GROUPS:
        group = group.when(age <= upper, F.lit(name))
    return group.otherwise(F.lit("nan"))


def service_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if any(mark in c for mark in SERVICE_MARKS)]


def derive(df: DataFrame) -> DataFrame:
    """Add rates, the number of services that read "Yes", and the age group (which
    replaces the age). Expects dataset names; skips what is not there."""
    added: dict[str, Column] = {}
    if "Tenure in Months" in df.columns:
        months = F.col(quoted("Tenure in Months"))
        if "Total Revenue" in df.columns:
            added["Revenue_per_Tenure"] = per_month(F.col(quoted("Total Revenue")), months)
        if "Total Charges" in df.columns:
            added["Charges_per_Month"] = per_month(F.col(quoted("Total Charges")), months)
    services = F.lit(0)
    for c in service_columns(df):
        services = services + F.coalesce((F.col(quoted(c)).cast("string") == "Yes").cast("int"), F.lit(0))
    added["Total_Services"] = services
    if "Age" in df.columns:
        added["Age_Group"] = age_group(F.col(quoted("Age")))
    return df.withColumns(added).drop("Age")
