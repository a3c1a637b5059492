"""Steps that must not move whole columns, or grow in one task, with the table."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from riskspark.operators import cells, neighbours, profile, quantiles, rebalance, split
from riskspark.sources import borrowers


def test_values_stay_where_they_are_while_ranks_are_narrowed(spark):
    """Joined by shuffling on the column's name, all values of a column were sorted in one task."""
    values = spark.range(1000).selectExpr("cast(id % 5 as int) as feature", "cast(id as double) as x")
    ranks = spark.createDataFrame([(0, 1, None, None), (3, 1, None, None)], "feature int, rank int, low double, high double")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = quantiles._inside(values, ranks, ["feature"], True)._jdf.queryExecution().executedPlan().toString()
        rows = spark.createDataFrame([(float(i % 97), i % 3) for i in range(3000)], "x double, g int")
        got = quantiles.quantiles(rows, ["x"], [0.25, 0.5], ["g"], order_rows=10).toPandas()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    want = rows.toPandas().groupby("g")["x"].quantile([0.25, 0.5]).to_dict()
    assert {(r.g, r.p): r.value for r in got.itertuples()} == want


def test_correlations_come_from_moments_of_tasks(spark):
    """A row used to become one row for each pair of columns; a constant column raised a division by zero."""
    rng = np.random.default_rng(1)
    a = rng.normal(1e6, 1, 4000)
    table = pd.DataFrame({"a": a, "b": a + rng.normal(0, 2, 4000), "c": 0.1, "d": np.where(np.arange(4000) % 3 == 0, rng.random(4000), np.nan)})
    rows = [tuple(None if math.isnan(v) else v for v in r) for r in table.itertuples(index=False)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(7)
    found = profile.corr_matrix(df, list("abcd"))
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString().partition("MapInArrow")[2]
    got = {(r["a"], r["b"]): r["r"] for r in found.collect()}
    want = table.corr()
    for x in "abd":
        for y in "abd":
            assert abs(got[x, y] - want.loc[x, y]) < 1e-9
    assert got["c", "c"] == 1.0 and got["c", "a"] is None and got["d", "c"] is None


def test_correlation_of_values_that_are_no_numbers(spark):
    df = spark.createDataFrame([(1.0, 2.0), (float("nan"), 3.0), (4.0, 5.0), (None, float("inf"))], "a double, b double")
    got = {(r["a"], r["b"]): r["r"] for r in profile.corr_matrix(df, ["a", "b"]).collect()}
    assert math.isnan(got["a", "b"]) and got["a", "a"] == 1.0
    one = profile.corr_matrix(df.limit(1), ["a", "b"]).collect()
    assert {(r["a"], r["b"]): r["r"] for r in one}["a", "b"] is None


def test_links_are_searched_from_the_smaller_classes(spark, monkeypatch):
    """Every row used to look for its nearest row; the links are those of brute force, with three classes and no label."""
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(600, 3)), 1)
    label = [None if i % 50 == 7 else int(v > 0.75) + int(v > 0.95) for i, v in enumerate(rng.random(600))]
    rows = [(i, label[i], *map(float, x[i])) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, target int, a double, b double, c double")
    gap = np.rint(((x[:, None] - x[None]) ** 2).sum(axis=2) * neighbours.UNIT)
    np.fill_diagonal(gap, np.inf)
    to = gap.argmin(axis=1)
    want = {(i, int(j)) for i, j in enumerate(to) if to[j] == i and None not in (label[i], label[j]) and label[i] != label[j]}
    asked = []
    whole = rebalance.search
    monkeypatch.setattr(rebalance, "search", lambda within, some: asked.append(some.count()) or whole(within, some))
    got = [tuple(r) for r in rebalance.tomek_pairs(df, ["a", "b", "c"], cell_rows=16).collect()]
    assert set(got) == want and len(got) == len(want) > 10
    assert sum(asked) < 400


def test_profile_counts_values_batch_by_batch(spark):
    """Counting before the shuffle used to hold all different values of a file split in one task."""
    rows = [(float(i % 7) if i % 5 else None, i) for i in range(30_000)]
    df = spark.createDataFrame(rows, "a double, b int")
    found = profile.column_profile(df, ["a", "b"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    at = next(i for i, line in enumerate(lines) if "MapInArrow" in line)
    above = next(line for line in reversed(lines[:at]) if "Exchange" in line or "HashAggregate" in line)
    assert "Exchange" in above
    got = {r["column"]: (r["missing"], r["unique"], r["min"], r["max"], r["mean"]) for r in found.collect()}
    assert got == {"a": (6000, 7, 0.0, 6.0, 3.0), "b": (0, 30_000, 0.0, 29_999.0, 14999.5)}


def test_lines_are_dealt_by_order_before_they_are_counted(spark, sf):
    tables = [borrowers.table(spark, sf, t) for t in ("orders", "customer", "lineitem")]
    plan = borrowers.derive_borrowers(*tables)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [l_orderkey" in plan


def test_few_and_many_ranks_are_found_alike(spark, monkeypatch):
    """Every value of a column was joined with each of its ranks, row by row, to narrow them."""
    rng = np.random.default_rng(5)
    odd = [float("inf"), float("-inf"), float("nan"), None, -0.0, 0.0, 5.0]
    rows = [
        (None if i % 11 == 0 else float("nan") if i % 13 == 0 else float(i % 4), odd[i % 7] if i % 5 == 0 else float(rng.normal()), float(rng.integers(3)))
        for i in range(6000)
    ]
    df = spark.createDataFrame(rows, "g double, x double, y double").repartition(5)
    asked = []
    monkeypatch.setattr(quantiles, "_inside", lambda *a, inside=quantiles._inside: asked.append(1) or inside(*a))
    monkeypatch.setattr(cells, "INTERVAL_SAMPLE", 100)

    def found(by, order_rows):
        got = quantiles.quantiles(df, ["x", "y"], [0.0, 0.01, 0.25, 0.5, 0.999, 1.0], by, order_rows).collect()
        return sorted(repr([v + 0.0 if isinstance(v, float) else v for v in r]) for r in got)

    few = {(by, n): found(list(by), n) for by, n in (((), None), (("g",), 7))}
    assert not asked
    monkeypatch.setattr(quantiles, "CELL_RANKS", 0)
    for (by, n), got in few.items():
        assert got == found(list(by), n)
    assert asked


def test_money_is_added_up_as_decimals_are(spark):
    """Every line's price and tax was cast to a decimal by way of its text and added to a decimal of 28 digits."""
    odd = [1.005, 2.675, -0.125, 0.005, -1.005, 1e15, 9.9e15, -3e13, 1099511627.775, 0.1, 1e-9, None, float("nan"), -0.0, 123456.78]
    rng = np.random.default_rng(8)
    rows = [(i % 40, odd[i % len(odd)]) for i in range(600)] + [(40 + i % 60, float(np.round(rng.normal(0, 1e5), int(rng.integers(1, 6))))) for i in range(3000)]
    rows += [(200, 9.9e15)] * 300 + [(201, None)]
    df = spark.createDataFrame(rows, "k int, x double")
    cents = df.select("k", "x", borrowers._cents(F.col("x")).alias("c"))
    got = cents.groupBy("k").agg(borrowers._money("c").alias("got"), F.sum(F.col("x").cast("decimal(18,2)")).cast("double").alias("want"))
    wrong = [r for r in got.collect() if r["got"] != r["want"]]
    assert not wrong and got.count() == 102


def test_a_row_is_hashed_once_for_its_split(spark):
    """Each comparison with a cut used to compute the hash again."""
    rows = spark.range(500).selectExpr("id", "cast(id % 3 = 0 as int) as target")
    plan = split.stratified_split(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 1
