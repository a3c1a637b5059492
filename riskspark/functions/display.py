"""Units and display strings as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskspark.functions.features import inv_log_income

# Fixed value: rupiah per dollar.
USD_TO_IDR = 16_000.0


def convert_currency(amount: Column, direction: str = "usd_to_idr", rate: float = USD_TO_IDR) -> Column:
    if direction == "usd_to_idr":
        return amount * F.lit(rate)
    if direction == "idr_to_usd":
        return amount * F.lit(1 / rate)
    raise ValueError(f"unknown direction {direction!r}")


def convert_percent(x: Column, direction: str = "to_percent") -> Column:
    if direction == "to_percent":
        return x * F.lit(100.0)
    if direction == "to_share":
        return x / F.lit(100.0)
    raise ValueError(f"unknown direction {direction!r}")


def fixed_text(x: Column, digits: int, commas: bool = False) -> Column:
    """Decimal text; ties are decided on the exact binary value, as C printf does."""
    text = F.format_number(x, digits)
    return text if commas else F.replace(text, F.lit(","), F.lit(""))


def format_currency(idr: Column) -> Column:
    """Rupiah in billions (M), millions (jt), thousands (rb) or units."""
    def scaled(unit: float, digits: int, suffix: str) -> Column:
        return F.concat(F.lit("Rp "), fixed_text(idr / F.lit(unit), digits), F.lit(suffix))

    return (
        F.when(idr.isNull(), None)
        .when(idr >= 1e9, scaled(1e9, 1, " M"))
        .when(idr >= 1e6, scaled(1e6, 1, " jt"))
        .when(idr >= 1e3, scaled(1e3, 0, " rb"))
        .otherwise(F.concat(F.lit("Rp "), fixed_text(idr, 0, commas=True)))
    )


# How each feature is shown, and the four utilisation level names.
MONEY_FEATURES = ("monthly_income", "income_per_dependent", "monthly_debt")
PERCENT_FEATURES = ("revolving_utilization", "debt_ratio", "dti_adjusted")
YES, NO = "Ya", "Tidak"
UTILIZATION_LEVELS = ("Aman", "Perhatian", "Tinggi", "Kritis")


def format_indicator(feature: Column, value: Column, decimals: int = 2) -> Column:
    """Display text of a feature value, by feature name."""
    level = F.least(value.cast("int"), F.lit(len(UTILIZATION_LEVELS) - 1))
    return (
        F.when(feature.isin(*MONEY_FEATURES), format_currency(convert_currency(value)))
        .when(feature.isin(*PERCENT_FEATURES),
              F.concat(fixed_text(convert_percent(value), 1), F.lit("%")))
        .when(feature == "ever_late", F.when(value >= 1, F.lit(YES)).otherwise(F.lit(NO)))
        .when(feature == "log_income", format_currency(convert_currency(inv_log_income(value))))
        .when(feature == "utilization_risk",
              F.get(F.array(*[F.lit(n) for n in UTILIZATION_LEVELS]), level))
        .otherwise(fixed_text(value, decimals))
    )
