"""Rank metrics, threshold metrics and curves over scored rows `(target, score or prob)`."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark.functions.features import round_half_even
from riskspark.operators.ordered import ordered_prefix
from riskspark.schema import LABEL

CUT = 0.5
# The threshold grid.
GRID_LOW, GRID_HIGH, GRID_SIZE = 0.1, 0.9, 80


def _class_prefix(
    df: DataFrame, label: str, score: str, by: Sequence[str], buckets: int | None, count: str | None = None
) -> DataFrame:
    n = F.lit(1) if count is None else F.col(count)
    flags = df.select(
        *by, score, (F.col(label) * n).cast("bigint").alias("pos"), ((1 - F.col(label)) * n).cast("bigint").alias("neg")
    )
    return ordered_prefix(flags, score, ["pos", "neg"], by, buckets)


def _share(part: Column, whole: Column) -> Column:
    """part / whole, and 0 where nothing is counted."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def roc_auc(
    df: DataFrame, label: str = LABEL, score: str = "score", by: Sequence[str] = (), buckets: int | None = None,
    count: str | None = None,
) -> DataFrame:
    """Exact rank AUC, ties counting half; null where a class is absent.

    `count` names the column with the number of rows a row stands for, if they are counted already.
    """
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    pairs = F.col("pos_total").cast("double") * F.col("neg_total")
    return (
        _class_prefix(df, label, score, by, buckets, count)
        .groupBy(*by)
        .agg(F.sum(pos * (F.col("neg_before") + neg / 2)).alias("won"), F.max(pairs).alias("pairs"))
        .select(*by, F.when(F.col("pairs") > 0, F.col("won") / F.col("pairs")).alias("auc"))
    )


def average_precision(
    df: DataFrame, label: str = LABEL, score: str = "score", by: Sequence[str] = (), buckets: int | None = None
) -> DataFrame:
    """Step sum of precision over recall increments, one step per distinct score."""
    step = F.col("pos") / F.col("pos_total") * _precision_at()
    return (
        _class_prefix(df, label, score, by, buckets).groupBy(*by)
        .agg(F.sum(F.when(F.col("pos") > 0, step).otherwise(0.0)).alias("ap"))
    )


def _tp_at() -> Column:
    return F.col("pos_total") - F.col("pos_before")


def _fp_at() -> Column:
    return F.col("neg_total") - F.col("neg_before")


def _precision_at() -> Column:
    return _tp_at() / (_tp_at() + _fp_at())


def _thinned(curve: DataFrame, by: Sequence[str], max_points: int | None) -> DataFrame:
    """Keep about `max_points` points, evenly spaced in rows seen, plus both ends."""
    if max_points is None:
        return curve
    total = F.col("pos_total") + F.col("neg_total")
    seen, ahead = F.col("tp") + F.col("fp"), F.col("tp") + F.col("fp") - F.col("pos") - F.col("neg")
    step = F.greatest(F.floor(total / F.lit(max_points)), F.lit(1))
    return curve.where((F.floor(seen / step) > F.floor(ahead / step)) | (ahead == 0) | (seen == total))


def _curve(df, label, score, by, max_points, buckets) -> DataFrame:
    points = _class_prefix(df, label, score, by, buckets).withColumns({"tp": _tp_at(), "fp": _fp_at()})
    return _thinned(points, by, max_points)


def roc_curve(
    df: DataFrame, label: str = LABEL, score: str = "score", by: Sequence[str] = (),
    max_points: int | None = None, buckets: int | None = None,
) -> DataFrame:
    """`(threshold, tp, fp, fpr, tpr)` for every distinct score, plus the (0, 0) end with no threshold."""
    points = _curve(df, label, score, by, max_points, buckets).select(
        *by, F.col(score).alias("threshold"), "tp", "fp",
        _share(F.col("fp"), F.col("neg_total")).alias("fpr"),
        _share(F.col("tp"), F.col("pos_total")).alias("tpr"),
    )
    nothing = df.groupBy(*by).agg(F.lit(0).cast("bigint").alias("tp")).select(
        *by, F.lit(None).cast(points.schema["threshold"].dataType).alias("threshold"), "tp",
        F.col("tp").alias("fp"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"),
    )
    return points.unionByName(nothing)


def pr_curve(
    df: DataFrame, label: str = LABEL, score: str = "score", by: Sequence[str] = (),
    max_points: int | None = None, buckets: int | None = None,
) -> DataFrame:
    """`(threshold, precision, recall)` for every distinct score, plus the (1, 0) end."""
    points = _curve(df, label, score, by, max_points, buckets).select(
        *by, F.col(score).alias("threshold"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        _share(F.col("tp"), F.col("pos_total")).alias("recall"),
    )
    nothing = df.groupBy(*by).agg(F.lit(1.0).alias("precision")).select(
        *by, F.lit(None).cast(points.schema["threshold"].dataType).alias("threshold"),
        "precision", F.lit(0.0).alias("recall"),
    )
    return points.unionByName(nothing)


def confusion_matrix(df: DataFrame, t: float = CUT, label: str = LABEL, prob: str = "prob", by=()) -> DataFrame:
    """Counts at a cut; a row is predicted positive (default) if `prob >= t`."""
    hit, bad = F.col(prob) >= t, F.col(label) == 1
    return df.groupBy(*by).agg(
        F.count_if(hit & bad).alias("tp"),
        F.count_if(hit & ~bad).alias("fp"),
        F.count_if(~hit & bad).alias("fn"),
        F.count_if(~hit & ~bad).alias("tn"),
    )


def precision_of(tp: Column, fp: Column) -> Column:
    return _share(tp, tp + fp)


def f1_of(tp: Column, fp: Column, fn: Column) -> Column:
    return _share(2 * tp, 2 * tp + fp + fn)


def precision_recall_f1(confusion: DataFrame) -> DataFrame:
    """Minority-class precision, recall and F1; 0 where undefined."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return confusion.withColumns(
        {"precision": precision_of(tp, fp), "recall": precision_of(tp, fn), "f1": f1_of(tp, fp, fn)}
    )


def f1_weighted(confusion: DataFrame) -> DataFrame:
    """F1 of both classes weighted by their support."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    bad, good = tp + fn, fp + tn
    both = f1_of(tp, fp, fn) * bad + f1_of(tn, fn, fp) * good
    return confusion.withColumn("f1_weighted", _share(both, bad + good))


def model_comparison(scored: DataFrame, t: float = CUT, score: str = "score", prob: str = "prob") -> DataFrame:
    """One row per (model, split) of long-form scored rows; each metric rounded to four places."""
    by = ["model", "split"]
    cuts = f1_weighted(precision_recall_f1(confusion_matrix(scored, t, prob=prob, by=by)))
    ranked = _class_prefix(scored, LABEL, score, by, None)
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    areas = ranked.groupBy(*by).agg(
        (F.sum(pos * (F.col("neg_before") + neg / 2)) / F.max(F.col("pos_total").cast("double") * F.col("neg_total")))
        .alias("auc_roc"),
        F.sum(F.when(F.col("pos") > 0, pos / F.col("pos_total") * _precision_at()).otherwise(0.0)).alias("ap"),
    )
    return areas.join(cuts, by).select(
        *by,
        round_half_even(F.col("auc_roc"), 4).alias("auc_roc"),
        round_half_even(F.col("f1_weighted"), 4).alias("f1_weighted"),
        round_half_even(F.col("f1"), 4).alias("f1_minority"),
        round_half_even(F.col("ap"), 4).alias("ap"),
    )


def filter_metrics_split(metrics: DataFrame, split: str = "test") -> DataFrame:
    return metrics.where(F.col("split") == split)


def grid_value(k: Column, lo: float, hi: float, n: int) -> Column:
    """k-th of `n` evenly spaced values, the last exactly `hi`."""
    return F.when(k == n - 1, F.lit(hi)).otherwise(F.lit(lo) + k * F.lit((hi - lo) / (n - 1)))


def grid_count(p: Column, lo: float, hi: float, n: int) -> Column:
    """How many grid values are `<= p`: an arithmetic guess, corrected by the grid values beside it."""
    step = (hi - lo) / (n - 1)
    guess = F.least(F.greatest(F.floor((p - F.lit(lo)) / F.lit(step)), F.lit(0)), F.lit(n - 1))
    return (
        F.when(p.isNull(), None)
        .when(p < lo, F.lit(0)).when(p >= hi, F.lit(n))
        .when(p < grid_value(guess, lo, hi, n), guess)
        .when(p >= grid_value(guess + 1, lo, hi, n), guess + 2)
        .otherwise(guess + 1).cast("int")
    )


def index_frame(df: DataFrame, n: int, name: str = "k") -> DataFrame:
    """The integers 0..n-1."""
    return df.sparkSession.range(n).select(F.col("id").cast("int").alias(name))


def threshold_sweep(
    df: DataFrame, lo: float = GRID_LOW, hi: float = GRID_HIGH, n: int = GRID_SIZE,
    label: str = LABEL, prob: str = "prob",
) -> DataFrame:
    """Counts and minority precision, recall and F1 at every cut of the grid.

    Each row is counted once, under the number of cuts it reaches; the counts at a cut are
    suffix sums over those `n + 1` groups.
    """
    reached = df.select(grid_count(F.col(prob), lo, hi, n).alias("reached"), F.col(label).alias("bad"))
    groups = reached.groupBy("reached").agg(
        F.sum("bad").alias("pos"), F.sum(1 - F.col("bad")).alias("neg")
    ).select((F.col("reached") - 1).alias("k"), "pos", "neg")
    every = index_frame(df, n + 1).select((F.col("k") - 1).alias("k"))
    onwards = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    filled = every.join(F.broadcast(groups), "k", "left").fillna(0, ["pos", "neg"])
    sums = filled.select(
        "k", F.sum("pos").over(onwards).alias("tp"), F.sum("neg").over(onwards).alias("fp"),
        F.sum("pos").over(Window.partitionBy()).alias("bad"),
    ).where("k >= 0").withColumn("fn", F.col("bad") - F.col("tp"))
    return precision_recall_f1(sums).select(
        "k", grid_value(F.col("k"), lo, hi, n).alias("threshold"), "tp", "fp", "fn", "precision", "recall", "f1"
    )


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The first cut with the highest F1."""
    return sweep.orderBy(F.desc("f1"), "k").limit(1)


def prevalence(df: DataFrame, label: str = LABEL) -> DataFrame:
    return df.agg(F.avg(label).alias("prevalence"))
