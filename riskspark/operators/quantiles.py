"""Exact, linearly interpolated quantiles.

Up to `CELL_RANKS` wanted order statistics are found by counting in the tasks (`cells`); more, those of many groups, as below.

Every wanted order statistic is a row of a table: its group, column and rank, the open interval known to hold
it, how many values lie at or below the interval's lower end, and how many inside. A round narrows the intervals
that hold more than `order_rows` values: a mergeable sketch of each interval proposes two values around the rank, a
counting pass decides on which side of them, between them or at which of them the rank lies. What is left in an
interval is counted by value and ordered there. Both passes are map-side aggregations joined with the table of
ranks, which is written after each round; groups are rows, not literals, so their number isn't bounded, and
a value that many rows share is one row. A sketch only proposes, so the result is exact whatever its error.
Up to `BROADCAST_RANKS` ranks go to the rows, which then never move; a shuffle by column would have as many tasks
as columns, each sorting all its values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark.operators.cells import Rank, find_ranks
from riskspark.session import materialize

#: An interval with at most so many values is ordered, a larger one is narrowed.
ORDER_ROWS = 1_000
GRID = 256
#: So many rows of the table of ranks are sent to the tasks; a larger table, that of very many groups, is shuffled.
BROADCAST_RANKS = 50_000
#: Up to so many ranks are kept on the driver.
CELL_RANKS = 2_000
NEVER_NULL = ("feature", "rank")


def quantiles(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = (), order_rows: int | None = None
) -> DataFrame:
    """Long frame `(by..., feature, p, value)`; an all-null column gives null, a null group is a group.

    Nulls and NaN are skipped. Infinities are values; between an infinity and another value lies the lower
    infinity, else the upper one.
    """
    keys = [f"_by{i}" for i in range(len(by))]
    # Stored wide; the long form exists only inside a scan. A column goes by its number, a short join key.
    wide = materialize(df.select(
        *[F.col(b).alias(k) for b, k in zip(by, keys)],
        *[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(f"_x{i}") for i, c in enumerate(cols)],
    ), "quantile-values")
    series = [*keys, "feature"]
    sizes = materialize(_sizes(wide, keys, len(cols)), "quantile-sizes")

    wanted = sizes.where("n > 0").select(*series, "n", F.explode(_ranks(probs)).alias("rank"))
    found = _found_few(wide, wanted, keys, order_rows)
    if found is None:
        found = _found_many(wide, wanted, keys, len(cols), ORDER_ROWS if order_rows is None else order_rows)
    named = F.get(F.array(*map(F.lit, cols)), F.col("feature")).alias("feature")
    return _interpolated(sizes, found, series, probs).select(
        *[F.col(k).alias(b) for b, k in zip(by, keys)], named, "p", "value"
    )


def _found_few(wide: DataFrame, wanted: DataFrame, keys: Sequence[str], order_rows: int | None) -> DataFrame | None:
    """`(keys..., feature, rank, value)` of the wanted ranks, or None if there are more than `CELL_RANKS`."""
    spark = wide.sparkSession
    # At most so many rows, so one window over all of them is bounded.
    number = F.dense_rank().over(Window.orderBy(*keys)) if keys else F.lit(0)
    ranks = wanted.limit(CELL_RANKS + 1).withColumn("_g", number.cast("int")).collect()
    if len(ranks) > CELL_RANKS:
        return None
    groups = {r["_g"]: tuple(r[k] for k in keys) for r in ranks}
    if keys:
        table = spark.createDataFrame([(*of, g) for g, of in groups.items()], T.StructType([*wide.select(*keys).schema, T.StructField("_g", T.IntegerType())]))
        rows = wide.alias("v").join(F.broadcast(table.alias("r")), _same("v", "r", keys)).select("v.*", "r._g")
    else:
        rows = wide.withColumn("_g", F.lit(0))
    located = find_ranks(rows, [Rank(r["_g"], r["feature"], r["rank"], r["n"]) for r in ranks], order_rows)
    return spark.createDataFrame(
        [(*groups[r.group], r.feature, r.rank, r.value) for r in located],
        T.StructType([*wanted.select(*keys, "feature", "rank").schema, T.StructField("value", T.DoubleType())]),
    )


def _found_many(wide: DataFrame, wanted: DataFrame, keys: Sequence[str], width: int, order_rows: int) -> DataFrame:
    """The same by joins with a table of ranks, of any number."""
    series = [*keys, "feature"]
    values = wide.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(i).alias("feature"), F.col(f"_x{i}").alias("x")) for i in range(width)
    ])))
    place = F.struct(*[F.lit(None).cast("double").alias(c) for c in ("low", "high")])
    state = wanted.select(
        *series, "rank", place["low"].alias("low"), place["high"].alias("high"),
        F.lit(0).cast("bigint").alias("below"), F.col("n").alias("inside"), F.lit(None).cast("double").alias("value"),
    )
    open_ = F.col("value").isNull() & (F.col("inside") > order_rows)
    while (sized := state.agg(F.count("*").alias("n"), F.count_if(open_).alias("open")).first())["open"]:
        few = sized["n"] <= BROADCAST_RANKS
        narrowed = _located(values, _proposed(values, state.where(open_), series, few), series, few)
        state = materialize(state.where(~open_).unionByName(narrowed), "quantile-ranks")
    few = sized["n"] <= BROADCAST_RANKS
    return state.where("value is not null").select(*series, "rank", "value").unionByName(
        _ordered(values, state.where("value is null"), series, few)
    )


def _sizes(wide: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """`(keys..., feature, n)`: the values of every column; without keys, a table without rows has its columns too."""
    counted = wide.groupBy(*keys).agg(*[F.count(f"_x{i}").alias(f"_n{i}") for i in range(width)])
    return counted.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(i).alias("feature"), F.col(f"_n{i}").alias("n")) for i in range(width)
    ])))


def _position(p: float) -> Column:
    return F.lit(float(p)) * (F.col("n") - 1)


def _ends(p: float) -> tuple[Column, Column]:
    """The ranks, from 0, on both sides of a quantile."""
    at = _position(p)
    return F.floor(at).cast("bigint"), F.least(F.ceil(at).cast("bigint"), F.col("n") - 1)


def _ranks(probs: Sequence[float]) -> Column:
    return F.array_distinct(F.array(*[end for p in probs for end in _ends(p)]))


def _same(a: str, b: str, cols: Sequence[str]) -> Column:
    cond = F.lit(True)
    for c in cols:
        x, y = F.col(f"{a}.{c}"), F.col(f"{b}.{c}")
        cond = cond & (x == y if c in NEVER_NULL else x.eqNullSafe(y))
    return cond


def _inside(values: DataFrame, rows: DataFrame, series: Sequence[str], few: bool) -> DataFrame:
    """`rows`, which `few` says can be broadcast, with every value x of their series in their open interval."""
    x = F.col("v.x")
    within = (F.col("r.low").isNull() | (x > F.col("r.low"))) & (F.col("r.high").isNull() | (x < F.col("r.high")))
    rows = F.broadcast(rows) if few else rows
    return values.alias("v").join(rows.alias("r"), _same("v", "r", series) & x.isNotNull() & within).select("r.*", "v.x")


def _proposed(values: DataFrame, ranks: DataFrame, series: Sequence[str], few: bool) -> DataFrame:
    """`ranks` with two values (a, b) of their interval, one on either side of the rank as far as a sketch knows."""
    interval = [*series, "low", "high"]
    grid = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])
    sketch = _inside(values, ranks.select(*interval).distinct(), series, few).groupBy(*interval).agg(
        F.percentile_approx("x", grid, 4 * GRID).alias("grid")
    )
    at = F.floor((F.col("rank") - F.col("below")) / F.col("inside") * GRID).cast("int")
    return ranks.alias("s").join(sketch.alias("g"), _same("s", "g", interval)).select(
        "s.*", F.get("grid", F.greatest(at - 1, F.lit(0))).alias("a"), F.get("grid", F.least(at + 2, F.lit(GRID))).alias("b")
    )


def _located(values: DataFrame, ranks: DataFrame, series: Sequence[str], few: bool) -> DataFrame:
    """Each rank at one of its two values, or in the open interval before, between or behind them."""
    x, a, b = F.col("x"), F.col("a"), F.col("b")
    counted = _inside(values, ranks.select(*series, "rank", "low", "high", "a", "b"), series, few).groupBy(*series, "rank").agg(
        F.count_if(x < a).alias("n1"), F.count_if(x <= a).alias("n2"), F.count_if((x <= a) | (x < b)).alias("n3"), F.count_if((x <= a) | (x <= b)).alias("n4"),
    )
    r = F.col("rank") - F.col("below")
    n1, n2, n3, n4 = (F.col(f"n{i}") for i in (1, 2, 3, 4))

    def pick(before, at_a, between, at_b, behind) -> Column:
        return F.when(r < n1, before).when(r < n2, at_a).when(r < n3, between).when(r < n4, at_b).otherwise(behind)

    below, none = F.col("below"), F.lit(None).cast("double")
    both = ranks.alias("s").join(counted.alias("c"), _same("s", "c", [*series, "rank"])).select("s.*", "n1", "n2", "n3", "n4")
    return both.select(
        *series, "rank", pick(F.col("low"), a, a, b, b).alias("low"), pick(a, a, b, b, F.col("high")).alias("high"),
        (below + pick(F.lit(0), n1, n2, n3, n4)).alias("below"),
        pick(n1, n2 - n1, n3 - n2, n4 - n3, F.col("inside") - n4).alias("inside"), pick(none, a, none, b, none).alias("value"),
    )


def _ordered(values: DataFrame, ranks: DataFrame, series: Sequence[str], few: bool) -> DataFrame:
    """The values of ranks whose intervals hold few values: counted by value, then ordered."""
    interval = [*series, "low", "high", "below"]
    counted = _inside(values, ranks.select(*interval).distinct(), series, few).groupBy(*interval, "x").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*interval).orderBy("x"))
    summed = counted.withColumn("upto", F.col("below") + upto)
    return ranks.select(*interval, "rank").alias("s").join(
        summed.alias("c"), _same("s", "c", interval) & (F.col("c.upto") > F.col("s.rank"))
    ).groupBy(*[F.col(f"s.{c}") for c in series], "s.rank").agg(F.min("c.x").alias("value"))


def _interpolated(sizes: DataFrame, found: DataFrame, series: Sequence[str], probs: Sequence[float]) -> DataFrame:
    points = F.inline(F.array(*[
        F.struct(F.lit(float(p)).alias("p"), *[e.alias(n) for n, e in zip(("k0", "k1"), _ends(p))], (_position(p) - F.floor(_position(p))).alias("part"))
        for p in probs
    ]))
    wanted = sizes.select(*series, "n", points)
    for end in ("0", "1"):
        other = found.select(*series, F.col("rank").alias("_k"), F.col("value").alias(f"x{end}"))
        wanted = wanted.alias("w").join(
            other.alias("f"), _same("w", "f", series) & (F.col(f"w.k{end}") == F.col("f._k")) & (F.col("w.n") > 0), "left"
        ).select("w.*", f"f.x{end}")
    lo, hi = F.col("x0"), F.col("x1")
    inf = F.lit(float("inf"))
    value = (
        F.when((lo == hi) | (F.col("part") == 0) | (F.abs(lo) == inf), lo).when(F.abs(hi) == inf, hi)
        .otherwise(lo + (hi - lo) * F.col("part"))
    )
    return wanted.withColumn("value", value)


def approx_quantiles(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = (), accuracy: int = 10_000
) -> DataFrame:
    """Same shape as `quantiles`, one sketch pass; returns elements, not interpolated values."""
    wide = df.groupBy(*by).agg(*[F.percentile_approx(c, list(probs), accuracy).alias(c) for c in cols])
    points = [
        F.struct(F.lit(c).alias("feature"), F.lit(float(p)).alias("p"), F.get(F.col(c), F.lit(i)).cast("double").alias("value"))
        for c in cols for i, p in enumerate(probs)
    ]
    return wide.select(*by, F.inline(F.array(*points)))
