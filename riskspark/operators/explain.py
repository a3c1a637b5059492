"""Additive contributions: linear models, ranking, case picking and dependence data.

A row's contributions travel as one array of `(feature, value, contribution)`, so everything
that looks at one row is a projection; only per-feature reports aggregate.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark.functions.features import round_half_even
from riskspark.operators.ordered import hash_key
from riskspark.operators.quantiles import quantiles
from riskspark.operators.split import SEED
from riskspark.schema import FEATURE_COLS, ID

# Rows explained by default, and the lengths of the reports.
SAMPLE_ROWS = 1_000
TOP_RANK, TOP_POINTS, TOP_REASONS, TOP_DEPENDENCE = 10, 15, 3, 4
DEPENDENCE_RANGE = (0.01, 0.99)


def sample_for_explain(df: DataFrame, n: int = SAMPLE_ROWS, seed: int = SEED, id_col: str = ID) -> DataFrame:
    """`n` rows by hash rank: a top-k per partition, merged, never a full sort."""
    return df.orderBy(hash_key(id_col, seed), id_col).limit(n)


def contribution_array(values: Mapping[str, Column], contributions: Mapping[str, Column]) -> Column:
    return F.array(*[
        F.struct(F.lit(f).alias("feature"), values[f].cast("double").alias("value"), c.alias("contribution"))
        for f, c in contributions.items()
    ])


def feature_means(df: DataFrame, cols: Sequence[str] = FEATURE_COLS, suffix: str = "") -> dict[str, float]:
    row = df.agg(*[F.avg(c + suffix).alias(c) for c in cols]).first()
    return {c: row[c] for c in cols}


def explain_linear(
    df: DataFrame, coef: Mapping[str, float], means: Mapping[str, float], suffix: str = "",
    digits: int | None = None,
) -> DataFrame:
    """`contributions`: weight x (value - mean) in log-odds per feature, rounded if `digits` is given.

    The weighted column is the feature's name plus `suffix`; the shown value is the bare name.
    """
    parts = {f: F.lit(w) * (F.col(f + suffix) - F.lit(means[f])) for f, w in coef.items()}
    if digits is not None:
        parts = {f: round_half_even(c, digits) for f, c in parts.items()}
    return df.withColumn("contributions", contribution_array({f: F.col(f) for f in coef}, parts))


def to_long(df: DataFrame, keys: Sequence[str] = (ID,), col: str = "contributions") -> DataFrame:
    """One row per feature: `(keys..., position, feature, value, contribution)`."""
    return df.select(*keys, F.posexplode(col).alias("position", "c")).select(*keys, "position", "c.*")


def importance_rank(
    df: DataFrame, n: int | None = TOP_RANK, features: Sequence[str] = FEATURE_COLS, col: str = "contributions"
) -> DataFrame:
    """Mean absolute contribution per feature, largest first; sums the array in place, no explode."""
    wide = df.agg(*[
        F.avg(F.abs(F.get(F.col(col), F.lit(i))["contribution"])).alias(f) for i, f in enumerate(features)
    ])
    long = wide.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(f).alias("feature"), F.col(f).alias("mean_abs"))
        for i, f in enumerate(features)
    ])))
    # As many rows as the model has features, so one window over all of them is bounded.
    ranked = long.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean_abs"), "position")))
    ranked = ranked.select("feature", "mean_abs", "rank")
    return ranked if n is None else ranked.where(F.col("rank") <= n)


def _strongest_features(df: DataFrame, n: int, features: Sequence[str], col: str) -> list[str]:
    """Names of the n features with the largest mean contribution: at most the model's width."""
    return [r["feature"] for r in importance_rank(df, n, features, col).orderBy("rank").collect()]


def _only(names: Sequence[str], features: Sequence[str], col: str) -> Column:
    at = list(features)
    return F.array(*[F.get(F.col(col), F.lit(at.index(f))) for f in names])


def beeswarm_data(
    df: DataFrame, n: int = TOP_POINTS, features: Sequence[str] = FEATURE_COLS, keys: Sequence[str] = (ID,),
    col: str = "contributions",
) -> DataFrame:
    """(feature, value, contribution) of every row for the n strongest features."""
    names = _strongest_features(df, n, features, col)
    return df.select(*keys, F.inline(_only(names, features, col)))


def dependence_data(
    df: DataFrame, n: int = TOP_DEPENDENCE, lo: float = DEPENDENCE_RANGE[0], hi: float = DEPENDENCE_RANGE[1],
    features: Sequence[str] = FEATURE_COLS, keys: Sequence[str] = (ID,), col: str = "contributions",
) -> DataFrame:
    """(value, contribution) of the strongest features, with the value between its outer quantiles."""
    names = _strongest_features(df, n, features, col)
    at = list(features)
    values = df.select(*[F.get(F.col(col), F.lit(at.index(f)))["value"].alias(f) for f in names])
    ends = {(r["feature"], r["p"]): r["value"] for r in quantiles(values, names, [lo, hi]).collect()}
    inside = F.lit(False)
    for f in names:
        inside = inside | ((F.col("feature") == f) & F.col("value").between(ends[f, lo], ends[f, hi]))
    return df.select(*keys, F.inline(_only(names, features, col))).where(inside)


def pick_cases(df: DataFrame, t: float, id_col: str = ID) -> DataFrame:
    """Safest, riskiest and borderline row; the smallest id wins a tie.

    The distance to the threshold is measured on the probability, the unit the threshold has.
    """
    row = F.struct(id_col, "margin", "prob")
    first = F.col(id_col)
    picked = df.agg(
        F.min_by(row, F.struct("margin", first)).alias("safest"),
        F.max_by(row, F.struct(F.col("margin"), -first)).alias("riskiest"),
        F.min_by(row, F.struct(F.abs(F.col("prob") - t), first)).alias("borderline"),
    )
    return picked.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("case"), F.col(c)[id_col].alias(id_col), F.col(c)["margin"].alias("margin"),
                 F.col(c)["prob"].alias("prob"))
        for c in ("safest", "riskiest", "borderline")
    ])))


def _sorted_by(order, col: str) -> Column:
    """The contribution array in ascending `order`, equal ones by feature position."""
    keyed = F.transform(F.col(col), lambda x, i: F.struct(
        order(x["contribution"]).alias("o"), i.alias("position"), x.alias("x")
    ))
    return F.transform(F.sort_array(keyed), lambda k: k["x"])


def strongest(n: int | None = None, col: str = "contributions") -> Column:
    """The contributions by absolute size, largest first; all of them without `n`."""
    ordered = _sorted_by(lambda c: -F.abs(c), col)
    return ordered if n is None else F.slice(ordered, 1, n)


def row_top_contrib(df: DataFrame, n: int = TOP_RANK, col: str = "contributions") -> DataFrame:
    """`top`: the row's n strongest contributions, shown from most negative to most positive."""
    kept = df.withColumn("top", strongest(n, col))
    return kept.withColumn("top", _sorted_by(lambda c: c, "top"))


def case_reasons(df: DataFrame, n: int = TOP_REASONS, col: str = "contributions") -> DataFrame:
    """`raising` and `lowering`: the n largest and n smallest contributions of the row."""
    return df.withColumns({
        "raising": F.slice(_sorted_by(lambda c: -c, col), 1, n),
        "lowering": F.slice(_sorted_by(lambda c: c, col), 1, n),
    })


def baseline_vs_final(df: DataFrame, expected: float, col: str = "contributions") -> DataFrame:
    """Margin before and after the contributions, and the same as probabilities."""
    total = F.aggregate(col, F.lit(0.0), lambda acc, x: acc + x["contribution"])
    base, final = F.lit(float(expected)), F.lit(float(expected)) + total

    def chance(m: Column) -> Column:
        return 1 / (1 + F.exp(-m))

    return df.withColumns({
        "base_margin": base, "final_margin": final, "diff_margin": total,
        "base_prob": chance(base), "final_prob": chance(final), "diff_prob": chance(final) - chance(base),
    })
