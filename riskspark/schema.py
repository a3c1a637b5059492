"""Column names, types and the ordered feature contract."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Raw file headers and the column names used everywhere else.
RAW_TO_NAME = {
    "SeriousDlqin2yrs": "target",
    "RevolvingUtilizationOfUnsecuredLines": "revolving_utilization",
    "age": "age",
    "NumberOfTime30-59DaysPastDueNotWorse": "late_30_59",
    "DebtRatio": "debt_ratio",
    "MonthlyIncome": "monthly_income",
    "NumberOfOpenCreditLinesAndLoans": "open_credit_lines",
    "NumberOfTimes90DaysLate": "late_90d",
    "NumberRealEstateLoansOrLines": "real_estate_loans",
    "NumberOfTime60-89DaysPastDueNotWorse": "late_60_89",
    "NumberOfDependents": "num_dependents",
}

DOUBLE_COLUMNS = {"revolving_utilization", "debt_ratio", "monthly_income", "num_dependents"}

ID, LABEL = "id", "target"

# The ten raw features and the nine derived ones, in model order.
RAW_FEATURES = [
    "revolving_utilization", "age", "late_30_59", "debt_ratio", "monthly_income",
    "open_credit_lines", "late_90d", "real_estate_loans", "late_60_89", "num_dependents",
]
DERIVED_FEATURES = [
    "total_late_payments", "weighted_late_score", "income_per_dependent", "monthly_debt",
    "dti_adjusted", "utilization_risk", "ever_late", "credit_lines_per_age", "log_income",
]
FEATURE_COLS = RAW_FEATURES + DERIVED_FEATURES


def _spark_type(name: str) -> T.DataType:
    return T.DoubleType() if name in DOUBLE_COLUMNS else T.IntegerType()


BORROWER_SCHEMA = T.StructType(
    [T.StructField(ID, T.LongType())]
    + [T.StructField(name, _spark_type(name)) for name in RAW_TO_NAME.values()]
)


def check_contract(df: DataFrame, cols: list[str] = FEATURE_COLS) -> DataFrame:
    """Fail unless the feature columns are present in contract order; runs no job."""
    found = [c for c in df.columns if c in set(cols)]
    if found != list(cols):
        raise ValueError(f"feature contract broken: expected {list(cols)}, found {found}")
    return df
