"""Profiling reports over the applicant table. Every report is one or two aggregations."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark.functions.features import round_half_even
from riskspark.operators.clean import clip_upper
from riskspark.operators.quantiles import approx_quantiles, quantiles
from riskspark.schema import ID, LABEL, RAW_FEATURES

# Histogram bins and cap, fence width, box-plot clip, watched columns,
# and the derived features shown as histograms (True = capped at the class quantile).
BINS, CAP_QUANTILE = 40, 0.99
FENCE = 1.5
BOX_CLIP = 0.95
WATCHED = ("age", "monthly_income", "revolving_utilization")
DERIVED_HISTOGRAMS = {
    "total_late_payments": True,
    "weighted_late_score": True,
    "income_per_dependent": False,
    "log_income": False,
    "dti_adjusted": True,
    "credit_lines_per_age": False,
}


def _to_long(wide: DataFrame, cols: Sequence[str], fields: Sequence[str], name: str = "column") -> DataFrame:
    """One-row frame with `<col>__<field>` columns -> one row per col."""
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias(name), *[F.col(f"{c}__{f}").alias(f) for f in fields]) for c in cols
    ])))


def _aggregate(df: DataFrame, cols: Sequence[str], fields: dict) -> DataFrame:
    return df.agg(*[make(F.col(c)).alias(f"{c}__{f}") for c in cols for f, make in fields.items()])


def table_shape(df: DataFrame, exclude: Sequence[str] = (ID,)) -> DataFrame:
    """Rows and columns; the id is the row index, not a column."""
    width = len([c for c in df.columns if c not in exclude])
    return df.agg(F.count("*").alias("n_rows"), F.lit(width).alias("n_cols"))


def duplicate_count(df: DataFrame, exclude: Sequence[str] = (ID,)) -> DataFrame:
    """Rows equal to an earlier row on every column but the id; nulls are equal."""
    cols = [c for c in df.columns if c not in exclude]
    copies = df.groupBy(*cols).agg(F.count("*").alias("n"))
    return copies.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def column_profile(df: DataFrame, cols: Sequence[str], approx: bool = False) -> DataFrame:
    """Per column: type, missing, distinct, min, max, mean, median.

    Exact: the rows become (column, value) pairs, counted within each Arrow batch, so common values are shuffled
    once a batch and no task holds the values of a file split; everything but the median is read off the counts. With `approx`, distinct counts
    and medians are sketches and only sketches are shuffled.
    """
    fields = ["missing", "missing_pct", "unique", "min", "max", "mean"]
    if approx:
        medians = approx_quantiles(df, cols, [0.5])
        made = {
            "missing": lambda c: F.count_if(c.isNull()),
            "rows": lambda c: F.count(F.lit(1)),
            "unique": F.approx_count_distinct,
            "min": lambda c: F.min(c).cast("double"),
            "max": lambda c: F.max(c).cast("double"),
            "mean": lambda c: F.avg(c),
        }
        facts = _to_long(_aggregate(df, cols, made), cols, list(made))
    else:
        medians = quantiles(df, cols, [0.5])
        wide = df.select(*[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(cols)])
        pairs = wide.mapInArrow(_counted_values, "i int, x double, n bigint").repartition("i", "x")
        name = F.get(F.array(*map(F.lit, cols)), F.col("i"))
        counts = pairs.groupBy("i", "x").agg(F.sum("n").alias("n")).withColumn("column", name)
        x, n = F.col("x"), F.col("n")
        facts = counts.groupBy("column").agg(
            F.coalesce(F.sum(F.when(x.isNull(), n)), F.lit(0)).alias("missing"), F.sum(n).alias("rows"),
            F.count(x).alias("unique"), F.min(x).alias("min"), F.max(x).alias("max"),
            (F.sum(x * n) / F.sum(F.when(x.isNotNull(), n))).alias("mean"),
        )
    types = dict(df.dtypes)
    dtype = F.create_map(*[F.lit(v) for c in cols for v in (c, types[c])])
    facts = facts.withColumns({
        "missing_pct": round_half_even(F.col("missing") / F.col("rows") * 100, 2),
        "mean": round_half_even(F.col("mean"), 2),
        "dtype": dtype[F.col("column")],
    })
    middle = medians.select(F.col("feature").alias("column"), round_half_even(F.col("value"), 2).alias("median"))
    return facts.join(middle, "column").select("column", "dtype", *fields, "median")


def _counted_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(column number, value, rows) for the different values of each column of a batch, null included."""
    for batch in batches:
        for i, c in enumerate(batch.columns):
            counted = c.value_counts()
            values, n = counted.field("values"), counted.field("counts")
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), i, np.int32)), values, n.cast(pa.int64())], names=["i", "x", "n"])


def class_balance(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Count and share per class, and the ratio of negatives to positives."""
    counts = df.groupBy(F.col(label).alias("class")).agg(F.count("*").alias("n"))
    every = Window.partitionBy()

    def of(k: int) -> Column:
        return F.sum(F.when(F.col("class") == k, F.col("n"))).over(every)

    return counts.select(
        "class", "n", (F.col("n") / F.sum("n").over(every) * 100).alias("pct"), (of(0) / of(1)).alias("ratio")
    )


def missing_report(df: DataFrame, cols: Sequence[str], median_cols: Sequence[str] = ("monthly_income",)) -> DataFrame:
    """Columns with missing values, most first, and how each is imputed."""
    fields = {"n": lambda c: F.count_if(c.isNull()), "rows": lambda c: F.count(F.lit(1))}
    long = _to_long(_aggregate(df, cols, fields), cols, list(fields))
    return long.where("n > 0").select(
        "column", "n", round_half_even(F.col("n") / F.col("rows") * 100, 2).alias("pct"),
        F.when(F.col("column").isin(*median_cols), "median").otherwise("mode").alias("strategy"),
    ).orderBy(F.desc("n"), "column")


def iqr_outliers(df: DataFrame, cols: Sequence[str] = RAW_FEATURES, k: float = FENCE) -> DataFrame:
    """Quartiles, fences and the rows strictly outside them; shares are over all rows."""
    found = {(r["feature"], r["p"]): r["value"] for r in quantiles(df, cols, [0.25, 0.75]).collect()}
    spread = {c: found[c, 0.75] - found[c, 0.25] for c in cols if found[c, 0.25] is not None}
    outside = {
        c: (F.col(c) < found[c, 0.25] - k * s) | (F.col(c) > found[c, 0.75] + k * s) for c, s in spread.items()
    }
    counted = df.agg(F.count("*").alias("rows"), *[F.count_if(x).alias(c) for c, x in outside.items()])
    report = counted.select("rows", F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.lit(found[c, 0.25]).alias("low"), F.lit(found[c, 0.75]).alias("high"),
                 F.lit(s).alias("spread"), F.col(c).alias("n_outliers"))
        for c, s in spread.items()
    ])))
    low, high, wide = F.col("low"), F.col("high"), F.col("spread")
    return report.select(
        "feature",
        round_half_even(low, 2).alias("q1"), round_half_even(high, 2).alias("q3"),
        round_half_even(wide, 2).alias("iqr"),
        round_half_even(low - k * wide, 2).alias("lower_fence"),
        round_half_even(high + k * wide, 2).alias("upper_fence"),
        "n_outliers",
        round_half_even(F.col("n_outliers") / F.col("rows") * 100, 2).alias("outlier_pct"),
    ).orderBy(F.desc("outlier_pct"), "feature")


def extreme_values(df: DataFrame, cols: Sequence[str] = WATCHED) -> DataFrame:
    fields = {"max": lambda c: F.max(c).cast("double")}
    return _to_long(_aggregate(df, cols, fields), cols, list(fields))


def class_histogram(
    df: DataFrame, cols: dict[str, bool] | Sequence[str], label: str = LABEL, bins: int = BINS,
    cap: float = CAP_QUANTILE,
) -> DataFrame:
    """Equal-width bins per (feature, class) over the values up to the class's cap quantile.

    The last bin is closed, empty bins are kept, and a constant column gets a unit-wide range.
    """
    capped = cols if isinstance(cols, dict) else dict.fromkeys(cols, True)
    values = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in capped
    ])
    long = df.select(F.col(label).alias("class"), F.inline(values)).where(F.col("x").isNotNull())

    # (feature, class) rows only: a few dozen at most, so broadcasting them is bounded.
    needs_cap = [c for c, on in capped.items() if on]
    if needs_cap:
        caps = quantiles(df, needs_cap, [cap], by=[label]).select(
            "feature", F.col(label).alias("class"), F.col("value").alias("cap")
        )
        long = long.join(F.broadcast(caps), ["feature", "class"], "left").where(
            F.col("cap").isNull() | (F.col("x") <= F.col("cap"))
        ).drop("cap")
    spans = long.groupBy("feature", "class").agg(
        F.min("x").alias("least"), F.max("x").alias("most"), F.count("*").alias("total")
    )
    half = F.when(F.col("least") == F.col("most"), 0.5).otherwise(0.0)
    spans = spans.select(
        "feature", "class", "total", (F.col("least") - half).alias("start"), (F.col("most") + half).alias("stop")
    ).withColumn("width", (F.col("stop") - F.col("start")) / bins)

    def edge(i: Column) -> Column:
        return F.when(i == bins, F.col("stop")).otherwise(F.col("start") + i * F.col("width"))

    x = F.col("x")
    guess = F.least(F.floor((x - F.col("start")) / F.col("width")), F.lit(bins - 1))
    placed = guess + F.when(x < edge(guess), -1).when((x >= edge(guess + 1)) & (guess < bins - 1), 1).otherwise(0)
    counts = long.join(F.broadcast(spans), ["feature", "class"]).groupBy(
        "feature", "class", placed.cast("int").alias("bin")
    ).agg(F.count("*").alias("n"))
    every = spans.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    n = F.coalesce("n", F.lit(0))
    return every.join(counts, ["feature", "class", "bin"], "left").select(
        "feature", "class", "bin", edge(F.col("bin")).alias("lo"), edge(F.col("bin") + 1).alias("hi"),
        n.alias("n"), (n / (F.col("total") * F.col("width"))).alias("density"),
    )


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson r of every ordered pair; each pair uses the rows where both values are present.

    A task turns its Arrow batches into one row of moments per pair, by matrix products, and the tasks' moments are
    merged: neither rows nor pairs of values are shuffled.
    """
    wide = df.select(*[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(cols)])
    parts = wide.mapInArrow(_pair_moments, _MOMENTS)
    part = F.struct(F.col("n").cast("double").alias("n"), "mx", "my", "xx", "yy", "xy")
    none = F.struct(*[F.lit(0.0).alias(f) for f in ("n", "mx", "my", "xx", "yy", "xy")])
    merged = parts.groupBy("i", "j").agg(F.aggregate(F.collect_list(part), none, _merged).alias("m")).select("i", "j", "m.*")
    spread = F.sqrt(F.col("xx") * F.col("yy"))
    half = merged.select(
        "i", "j", F.when((F.col("i") == F.col("j")) & (F.col("n") > 0), 1.0)
        .when((F.col("n") > 1) & (spread != 0), F.col("xy") / spread).alias("r")
    )
    mirrored = half.select(F.explode(F.array(
        F.struct("i", "j", "r"), F.when(F.col("i") != F.col("j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "r"))
    )).alias("p")).where("p is not null").select("p.*")
    names = F.array(*[F.lit(c) for c in cols])
    return mirrored.select(F.get(names, F.col("i")).alias("a"), F.get(names, F.col("j")).alias("b"), "i", "j", "r")


_MOMENTS = "i int, j int, n bigint, mx double, my double, xx double, yy double, xy double"


def _merged(a: Column, b: Column) -> Column:
    """Moments of two disjoint sets of rows together: n, means, sums of squares and of products about the means."""
    n, dx, dy = a["n"] + b["n"], b["mx"] - a["mx"], b["my"] - a["my"]
    share = F.when(n > 0, b["n"] / n).otherwise(0.0)
    weight = a["n"] * share
    return F.struct(
        n.alias("n"), F.when(a["n"] > 0, a["mx"] + dx * share).otherwise(b["mx"]).alias("mx"),
        F.when(a["n"] > 0, a["my"] + dy * share).otherwise(b["my"]).alias("my"),
        (a["xx"] + b["xx"] + dx * dx * weight).alias("xx"), (a["yy"] + b["yy"] + dy * dy * weight).alias("yy"),
        (a["xy"] + b["xy"] + dx * dy * weight).alias("xy"),
    )


def _pair_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's moments of every pair i >= j of columns over the rows that have both."""
    n = mean = square = product = None
    for batch in batches:
        if not batch.num_rows:
            continue
        m, mu, sq, pr = _batch_moments(batch)
        if n is None:
            n, mean, square, product = m, mu, sq, pr
            continue
        both = n + m
        share = np.divide(m, both, out=np.zeros_like(both), where=both > 0)
        d = np.where((n > 0) & (m > 0), mu - mean, 0.0)
        mean = np.where(n > 0, mean + d * share, mu)
        square = square + sq + d * d * n * share
        product = product + pr + d * d.T * n * share
        n = both
    if n is not None:
        i, j = np.tril_indices(len(n))
        out = [i.astype(np.int32), j.astype(np.int32), n[i, j].astype(np.int64), mean[i, j], mean[j, i], square[i, j], square[j, i], product[i, j]]
        names = [part.split()[0] for part in _MOMENTS.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=names)


def _batch_moments(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(n, mean, square, product) of all pairs; row i, column j: of column i over the rows that have i and j.

    Values are taken relative to one of their column, so that equal ones give exactly 0. A value that is no finite
    number makes its pairs' moments NaN.
    """
    there = np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns])
    x = np.stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in batch.columns])
    odd = there & ~np.isfinite(x)
    x = np.where(odd, 0.0, x)
    valid = there.astype(float)
    mid = x.sum(axis=1, keepdims=True) / np.maximum(valid.sum(axis=1, keepdims=True), 1)
    nearest = np.where(there, np.abs(x - mid), np.inf).argmin(axis=1)
    pivot = x[np.arange(len(x)), nearest][:, None]
    y = (x - pivot) * valid
    n, total, squares = valid @ valid.T, y @ valid.T, (y * y) @ valid.T
    some = np.maximum(n, 1)
    mean, square, product = pivot + total / some, squares - total**2 / some, y @ y.T - total * total.T / some
    # Where rounding could hide that all values are equal, they are looked at one by one.
    for i, j in zip(*np.nonzero((square <= 1e-9 * squares) & (n > 0))):
        values = x[i, there[i] & there[j]]
        mean[i, j] = values[0] if values.min() == values.max() else values.mean()
        square[i, j] = ((values - mean[i, j]) ** 2).sum()
    if odd.any():
        hit = odd.astype(float) @ valid.T > 0
        bad = hit | hit.T
        square[bad] = product[bad] = mean[bad] = np.nan
    return n, mean, square, product


def corr_lower_triangle(corr: DataFrame) -> DataFrame:
    return corr.where("i > j")


def target_corr_rank(corr: DataFrame, target: str = LABEL) -> DataFrame:
    """|r| with the target, strongest first."""
    return corr.where((F.col("a") != target) & (F.col("b") == target)).select(
        F.col("a").alias("feature"), F.abs("r").alias("abs_r")
    ).orderBy(F.desc("abs_r"), "feature")


def class_compare(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Defaulters against the rest: means, median income, difference and ratio."""
    means = ["age", "revolving_utilization", "late_30_59", "late_60_89", "late_90d"]
    bad, good = F.col(label) == 1, F.col(label) == 0
    wide = df.agg(*[
        F.avg(F.when(side, F.col(c))).alias(f"mean_{c}__{name}")
        for c in means for name, side in (("bad", bad), ("good", good))
    ])
    long = _to_long(wide, [f"mean_{c}" for c in means], ["bad", "good"], "metric")
    medians = quantiles(df, ["monthly_income"], [0.5], by=[label]).agg(
        F.max(F.when(bad, F.col("value"))).alias("bad"), F.max(F.when(good, F.col("value"))).alias("good")
    ).select(F.lit("median_monthly_income").alias("metric"), "bad", "good")
    return long.unionByName(medians).select(
        "metric", "bad", "good", (F.col("good") - F.col("bad")).alias("diff"),
        F.when(F.col("good") != 0, F.col("bad") / F.col("good")).alias("ratio"),
    )


def box_stats(df: DataFrame, col: str, label: str = LABEL, clip: float = BOX_CLIP, k: float = FENCE) -> DataFrame:
    """Quartiles and whisker ends per class, after capping at the overall `clip` quantile."""
    cap = quantiles(df, [col], [clip]).first()["value"]
    values = clip_upper(df.where(F.col(col).isNotNull()), col, cap)

    def at(p: float) -> Column:
        return F.max(F.when(F.col("p") == p, F.col("value")))

    boxes = quantiles(values, [col], [0.25, 0.5, 0.75], by=[label]).groupBy(label).agg(
        at(0.25).alias("q1"), at(0.5).alias("med"), at(0.75).alias("q3")
    )
    reach = k * (F.col("q3") - F.col("q1"))
    x = F.col(col)
    # One row per class on the broadcast side.
    return values.join(F.broadcast(boxes), label).groupBy(F.col(label).alias("class"), "q1", "med", "q3").agg(
        F.min(F.when(x >= F.col("q1") - reach, x)).alias("lo"),
        F.max(F.when(x <= F.col("q3") + reach, x)).alias("hi"),
    ).select("class", F.least("lo", "q1").alias("lo"), "q1", "med", "q3", F.greatest("hi", "q3").alias("hi"))
