"""Derived credit features as Column expressions, shared by training and serving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Severity weights of the 30-, 60- and 90-day counts; utilisation edges.
LATE_WEIGHTS = (1, 2, 4)
UTILIZATION_EDGES = (-0.01, 0.30, 0.70, 1.00)


def round_half_even(x: Column, digits: int) -> Column:
    """Scale, round to the nearest even integer, scale back."""
    factor = float(10**digits)
    return F.rint(x * F.lit(factor)) / F.lit(factor)


def total_late(l30: Column, l60: Column, l90: Column) -> Column:
    return l30 + l60 + l90


def weighted_late(l30: Column, l60: Column, l90: Column, weights=LATE_WEIGHTS) -> Column:
    return sum((F.lit(w) * c for w, c in zip(weights[1:], (l60, l90))), F.lit(weights[0]) * l30)


def income_per_dependent(income: Column, dependents: Column) -> Column:
    return income / (dependents + 1)


def monthly_debt(debt_ratio: Column, income: Column) -> Column:
    return debt_ratio * income


def dti_adjusted(debt: Column, income: Column) -> Column:
    return debt / (income + 1)


def right_closed_code(x: Column, edges, strict: bool = False) -> Column:
    """0-based index of the bin (edges[i], edges[i+1]]; the last bin is open above.

    Null or a value at or below the first edge gives null, or an error if `strict`.
    """
    code = F.when(x.isNull() | F.isnan(x) | (x <= edges[0]),
                  F.raise_error(F.lit("value outside the bins")).cast("int") if strict
                  else F.lit(None).cast("int"))
    for i, upper in enumerate(edges[1:]):
        code = code.when(x <= upper, F.lit(i))
    return code.otherwise(F.lit(len(edges) - 1))


def utilization_risk(utilization: Column, edges=UTILIZATION_EDGES, strict: bool = False) -> Column:
    return right_closed_code(utilization, edges, strict)


def ever_late(total: Column) -> Column:
    return (total > 0).cast("int")


def credit_lines_per_age(lines: Column, age: Column, digits: int = 4) -> Column:
    return round_half_even(lines / age, digits)


def log_income(income: Column) -> Column:
    return F.log1p(income)


def inv_log_income(value: Column) -> Column:
    return F.expm1(value)


def engineer_features(df: DataFrame, strict: bool = False) -> DataFrame:
    """Add the nine derived features; a pure projection, so it also runs on a stream."""
    c = F.col
    late = (c("late_30_59"), c("late_60_89"), c("late_90d"))
    return df.withColumns({
        "total_late_payments": total_late(*late),
        "weighted_late_score": weighted_late(*late),
        "income_per_dependent": income_per_dependent(c("monthly_income"), c("num_dependents")),
        "monthly_debt": monthly_debt(c("debt_ratio"), c("monthly_income")),
        "utilization_risk": utilization_risk(c("revolving_utilization"), strict=strict),
        "credit_lines_per_age": credit_lines_per_age(c("open_credit_lines"), c("age")),
        "log_income": log_income(c("monthly_income")),
    }).withColumns({
        "dti_adjusted": dti_adjusted(c("monthly_debt"), c("monthly_income")),
        "ever_late": ever_late(c("total_late_payments")),
    })
