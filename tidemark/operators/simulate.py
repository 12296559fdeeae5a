"""Propensities and time lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

def monthly_hazard(annual: Column) -> Column:
    """A twelfth of an annual propensity, kept in [0, 0.5]."""
    return F.least(F.greatest(annual / 12, F.lit(0.0)), F.lit(0.5))


def annual_propensity(base: Column, *factors: Column) -> Column:
    """A base rate times its factors (a null one is 1): a weight, so it may well be above 1."""
    out = base
    for f in factors:
        out = out * F.coalesce(f, F.lit(1.0))
    return out


def compress_timeline(events: DataFrame, by: str, month: str, horizon: int) -> DataFrame:
    """Months of a longer timeline scaled into ``horizon``: int(month * (horizon - 2) / span) if the span is at least the horizon, else as they are."""
    from pyspark.sql import Window as W

    span = F.max(month).over(W.partitionBy(by))
    scaled = F.when(span >= horizon, (F.col(month) * (horizon - 2) / span).cast("int")).otherwise(F.col(month).cast("int"))
    return events.withColumn("month_scaled", scaled).filter(F.col("month_scaled").between(0, horizon - 1))
