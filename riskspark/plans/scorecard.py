"""Frozen scorecards: fixed coefficients that make scoring and metrics exactly checkable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.operators.clean import filter_age
from riskspark.schema import FEATURE_COLS, ID, LABEL

# Cards A and B act on raw columns, the scaled card on the 19 scaled features.
SCALED_INTERCEPT = -0.4
SCALED_WEIGHTS = {
    "revolving_utilization": 0.45, "age": -0.2, "late_30_59": 0.3, "debt_ratio": 0.05,
    "monthly_income": -0.07, "open_credit_lines": 0.04, "late_90d": 0.8, "real_estate_loans": 0.03,
    "late_60_89": 0.5, "num_dependents": 0.06, "total_late_payments": 0.15, "weighted_late_score": 0.1,
    "income_per_dependent": -0.05, "monthly_debt": 0.02, "dti_adjusted": 0.08, "utilization_risk": 0.25,
    "ever_late": 0.35, "credit_lines_per_age": 0.09, "log_income": -0.11,
}
THRESHOLD = 0.5354


def logistic(margin: Column) -> Column:
    return 1 / (1 + F.exp(-margin))


def margin_a() -> Column:
    c = F.col
    return (-1.2 + 0.9 * F.least(c("revolving_utilization"), F.lit(1.5)) + 1.1 * c("late_90d")
            + 0.6 * c("late_60_89") + 0.35 * c("late_30_59") - 0.012 * (c("age") - 50))


def margin_b() -> Column:
    c = F.col
    return (-0.9 + 0.5 * F.least(c("revolving_utilization"), F.lit(1.5))
            + 0.9 * (c("late_90d") + c("late_60_89") + c("late_30_59")))


def linear_margin(weights: dict[str, float], intercept: float, suffix: str = "") -> Column:
    total = F.lit(intercept)
    for name in FEATURE_COLS:
        if name in weights:
            total = total + F.lit(weights[name]) * F.col(name + suffix)
    return total


def with_score(df: DataFrame, margin: Column) -> DataFrame:
    """Add margin, probability and the integer ranking key that makes ties engine-independent."""
    return df.withColumn("margin", margin).withColumns({
        "prob": logistic(F.col("margin")),
        "score": F.round(F.col("margin") * 1e6).cast("bigint"),
    })


def card_a(borrowers: DataFrame) -> DataFrame:
    return with_score(filter_age(borrowers), margin_a()).select(ID, LABEL, "margin", "prob", "score")


def card_b(borrowers: DataFrame) -> DataFrame:
    return with_score(filter_age(borrowers), margin_b()).select(ID, LABEL, "margin", "prob", "score")
