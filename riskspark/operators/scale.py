"""Robust scaling with exact quantiles: centre on the median, divide by the quartile range."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.operators.quantiles import quantiles
from riskspark.schema import FEATURE_COLS

# A range this small counts as zero, and a zero range scales by one.
ZERO_RANGE = 10 * 2.220446049250313e-16


def robust_scale_fit(train: DataFrame, cols: Sequence[str] = FEATURE_COLS) -> DataFrame:
    """`(feature, center, scale)`, one row per column, from the training rows only."""
    def at(p: float):
        return F.max(F.when(F.col("p") == p, F.col("value")))

    return quantiles(train, cols, [0.25, 0.5, 0.75]).groupBy("feature").agg(
        at(0.5).alias("center"), (at(0.75) - at(0.25)).alias("scale")
    )


def robust_scale_apply(
    df: DataFrame, params: DataFrame | dict[str, tuple[float, float]], suffix: str = ""
) -> DataFrame:
    """Scale the fitted columns, in place or into columns with a suffix; one parameter row per feature."""
    if isinstance(params, DataFrame):
        params = scale_values(params)
    return df.withColumns({
        name + suffix: (F.col(name) - F.lit(center)) / F.lit(1.0 if scale < ZERO_RANGE else scale)
        for name, (center, scale) in params.items()
    })


def scale_values(params: DataFrame) -> dict[str, tuple[float, float]]:
    return {r["feature"]: (r["center"], r["scale"]) for r in params.collect()}
