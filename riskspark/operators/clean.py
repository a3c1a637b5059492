"""Row filters, clipping, imputation and data-quality rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.functions.display import convert_currency, convert_percent
from riskspark.functions.features import right_closed_code
from riskspark.operators.quantiles import quantiles
from riskspark.schema import LABEL

# Plausible ages, utilisation ceiling, age bins and their names.
AGE_LOW, AGE_HIGH = 0, 95
UTILIZATION_CAP = 1.5
AGE_EDGES = (0, 30, 45, 60, 100)
AGE_LABELS = ("<30", "30-45", "45-60", "60+")

# The ranges the application form accepts, in the units it shows.
INPUT_BOUNDS = {
    "age": (18, 90),
    "num_dependents": (0, 10),
    "monthly_income_idr": (500_000, 100_000_000),
    "utilization_pct": (0, 150),
    "debt_pct": (0, 100),
    "open_credit_lines": (0, 30),
    "real_estate_loans": (0, 10),
    "late_30_59": (0, 15),
    "late_60_89": (0, 15),
    "late_90d": (0, 15),
}
THRESHOLD_BOUNDS = (0.10, 0.90)


def filter_age(df: DataFrame, lo: int = AGE_LOW, hi: int = AGE_HIGH) -> DataFrame:
    return df.where((F.col("age") > lo) & (F.col("age") <= hi))


def clip_upper(df: DataFrame, col: str, upper: float) -> DataFrame:
    """Cap a column from above; null stays null."""
    return df.withColumn(col, F.when(F.col(col) > upper, F.lit(upper)).otherwise(F.col(col)))


def clip_utilization(df: DataFrame, upper: float = UTILIZATION_CAP) -> DataFrame:
    return clip_upper(df, "revolving_utilization", upper)


def bin_age_group(
    df: DataFrame, col: str = "age", edges: Sequence[float] = AGE_EDGES, labels: Sequence[str] = AGE_LABELS
) -> DataFrame:
    """Name of the right-closed bin; null outside the edges."""
    x = F.col(col)
    code = F.when(x <= edges[-1], right_closed_code(x, edges[:-1]))
    return df.withColumn("age_group", F.get(F.array(*[F.lit(n) for n in labels]), code))


def group_median(df: DataFrame, by: str = "age_group", col: str = "monthly_income") -> DataFrame:
    return quantiles(df, [col], [0.5], by=[by]).select(by, F.col("value").alias("median"))


def global_median(df: DataFrame, col: str = "monthly_income") -> DataFrame:
    return quantiles(df, [col], [0.5]).select(F.col("value").alias("median"))


def fit_income_medians(df: DataFrame) -> DataFrame:
    """One row per age group, `(age_group, income_median)`.

    A group without any income takes the median of the whole table, so the frame is complete
    and applying it needs one lookup.
    """
    names = df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, AGE_LABELS))).alias("age_group"))
    overall = global_median(df).scalar()
    return names.join(group_median(df), "age_group", "left").select(
        "age_group", F.coalesce("median", overall).alias("income_median")
    )


def impute_group_median(df: DataFrame, medians: DataFrame) -> DataFrame:
    """Missing income becomes its age group's median; `medians` has one row per age group."""
    return (
        df.join(F.broadcast(medians), "age_group", "left")
        .withColumn("monthly_income", F.coalesce("monthly_income", "income_median"))
        .drop("income_median")
    )


def impute_constant(df: DataFrame, values: Mapping[str, float]) -> DataFrame:
    return df.fillna(dict(values))


def drop_helper(df: DataFrame, cols: Sequence[str] = ("age_group",)) -> DataFrame:
    return df.drop(*cols)


def prepare(df: DataFrame) -> DataFrame:
    """The rows and columns on which medians are fitted: age filter, cap, age group."""
    return bin_age_group(clip_utilization(filter_age(df)))


def apply_cleaning(df: DataFrame, medians: DataFrame) -> DataFrame:
    """Filter, cap and impute with already fitted medians; runs on batches and streams."""
    imputed = impute_constant(impute_group_median(prepare(df), medians), {"num_dependents": 0})
    return drop_helper(imputed).select(*df.columns)


def clean(df: DataFrame) -> DataFrame:
    return apply_cleaning(df, fit_income_medians(prepare(df)))


def cleaning_audit(df: DataFrame) -> DataFrame:
    """`(rule, n_rows)` touched by each cleaning rule, from one pass over the raw rows."""
    kept = (F.col("age") > AGE_LOW) & (F.col("age") <= AGE_HIGH)
    kept = F.coalesce(kept, F.lit(False))
    rules = {
        "rows_in": F.lit(True),
        "age_removed": ~kept,
        "utilization_capped": kept & (F.col("revolving_utilization") > UTILIZATION_CAP),
        "income_imputed": kept & F.col("monthly_income").isNull(),
        "dependents_imputed": kept & F.col("num_dependents").isNull(),
        "rows_out": kept,
    }
    counted = df.agg(*[F.count_if(cond).alias(rule) for rule, cond in rules.items()])
    return counted.select(F.inline(F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.col(rule).alias("n_rows")) for rule in rules
    ])))


def filter_by_class(df: DataFrame, label: int, col: str = LABEL) -> DataFrame:
    return df.where(F.col(col) == label)


def drop_nulls_col(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col).isNotNull())


def _form_units() -> dict[str, Column]:
    """The bounded quantities of the form, from the table's own columns."""
    special = {
        "monthly_income_idr": convert_currency(F.col("monthly_income")),
        "utilization_pct": convert_percent(F.col("revolving_utilization")),
        "debt_pct": convert_percent(F.col("debt_ratio")),
    }
    return {name: special.get(name, F.col(name)) for name in INPUT_BOUNDS}


def input_bounds(df: DataFrame, bounds: Mapping[str, tuple[float, float]] = INPUT_BOUNDS) -> DataFrame:
    """Add `violations`, the names of the bounded quantities a row breaks (null breaks none)."""
    units = _form_units()
    checks = [
        F.when((units[name] < lo) | (units[name] > hi), F.lit(name)) for name, (lo, hi) in bounds.items()
    ]
    return df.withColumn("violations", F.filter(F.array(*checks), lambda v: v.isNotNull()))


def check_threshold(threshold: float) -> float:
    lo, hi = THRESHOLD_BOUNDS
    if not lo <= threshold <= hi:
        raise ValueError(f"threshold {threshold} outside {lo}..{hi}")
    return threshold
