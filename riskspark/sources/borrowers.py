"""The applicant table, derived from orders, customers and line items."""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.schema import BORROWER_SCHEMA
from riskspark.session import scratch_path

LINES_PER_TASK = 2_000_000
#: Cents are added up above and below this unit.
CENT_PART = 10**9
_written: dict[tuple[str, str], str] = {}


def _cents(x: Column) -> Column:
    """`x` as decimal(18,2), in cents. Only values next to a half of a cent, or large, need the decimal, a cast by text."""
    scaled = x * 100
    clear = (F.abs(scaled) < 2.0**40) & (F.abs(scaled - F.floor(scaled) - 0.5) > 0.001)
    return F.when(clear, F.rint(scaled).cast("bigint")).otherwise((x.cast("decimal(18,2)") * 100).cast("bigint"))


def _money(name: str) -> Column:
    """Exact sums of a column's cents, in two parts that can't overflow, as the double next to their sum."""
    whole, rest = F.sum(F.expr(f"{name} div {CENT_PART}")), F.sum(F.expr(f"{name} % {CENT_PART}"))
    wide = [part.cast("decimal(20,0)") for part in (whole, rest)]
    exact = wide[0] * F.lit(Decimal(CENT_PART // 100)) + wide[1] * F.lit(Decimal("0.01"))
    # Up to 2^53 cents a double holds the sum itself, and the division rounds once, as the decimal's cast does.
    small = F.abs(whole) < 2**53 // CENT_PART - 1
    return F.when(small & (F.abs(rest) < CENT_PART), (whole * CENT_PART + rest) / F.lit(100.0)).otherwise(exact.cast("double"))


def derive_borrowers(orders: DataFrame, customer: DataFrame, lineitem: DataFrame) -> DataFrame:
    """One applicant per order: late counts, debt and credit lines come from its line items."""
    c = F.col
    # Line items collapse to one row per order before any join; the supplier groups 0..3 are
    # counted with a bit mask instead of a distinct aggregate, which would shuffle twice.
    # Dealt by order before they are counted: a task's hash table holds the orders of its share, not of a file split.
    cores = lineitem.sparkSession.sparkContext.defaultParallelism
    tasks = cores * max(1, math.ceil(lineitem.count() / (LINES_PER_TASK * cores)))
    dealt = lineitem.select(
        "l_orderkey", "l_suppkey", "l_partkey",
        _cents(c("l_extendedprice").cast("double")).alias("gross"), _cents(c("l_tax").cast("double")).alias("tax"),
    ).repartition(tasks, "l_orderkey")
    lines = dealt.groupBy("l_orderkey").agg(
        F.count("*").alias("n_lines"),
        F.bit_count(F.bit_or(F.expr("shiftleft(1, cast(l_suppkey % 4 as int))"))).alias("n_grp"),
        _money("gross").alias("gross"), _money("tax").alias("tax"),
        F.count_if(c("l_partkey") % 20 == 0).alias("d30"),
        F.count_if(c("l_partkey") % 50 == 1).alias("d60"),
        F.count_if(c("l_partkey") % 40 == 2).alias("d90"),
    )
    joined = orders.join(customer, c("o_custkey") == c("c_custkey")).join(
        lines, c("o_orderkey") == c("l_orderkey"), "left"
    )

    def filled(name: str, value) -> Column:
        return F.coalesce(c(name), F.lit(value))

    key, cust = c("o_orderkey"), c("o_custkey")
    base = joined.select(
        key.alias("id"),
        (filled("gross", 0.0) / c("o_totalprice") * 0.4).alias("revolving_utilization"),
        F.when(key % 997 == 1, 0).otherwise(18 + (cust * 7 + key) % 84).alias("age"),
        filled("d30", 0).alias("late_30_59"),
        (filled("tax", 0.0) * 3.0).alias("debt_ratio"),
        F.when(key % 5 != 3, c("o_totalprice") / 40.0).alias("monthly_income"),
        (filled("n_lines", 0) + c("c_nationkey") % 10).alias("open_credit_lines"),
        filled("d90", 0).alias("late_90d"),
        filled("n_grp", 0).alias("real_estate_loans"),
        filled("d60", 0).alias("late_60_89"),
        F.when(key % 37 != 5, (cust % 5).cast("double")).alias("num_dependents"),
        ((key * 7919 + cust * 104729) % 1000).alias("noise"),
    )
    risk = (
        20 + 150 * F.least(c("late_90d"), F.lit(3)) + 90 * F.least(c("late_60_89"), F.lit(3))
        + 50 * F.least(c("late_30_59"), F.lit(3))
        + F.when(c("revolving_utilization") > 1.0, 90).otherwise(0)
        + F.when(c("age") < 35, 30).otherwise(0)
    )
    labelled = base.withColumn("target", (c("noise") < risk).cast("int"))
    return labelled.select(*[c(f.name).cast(f.dataType).alias(f.name) for f in BORROWER_SCHEMA])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def borrowers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived table, written once per application to the shared folder."""
    slot = (spark.sparkContext.applicationId, sf_dir)
    if slot not in _written:
        path = scratch_path(spark, "borrowers")
        orders, customer, lineitem = (table(spark, sf_dir, t) for t in ("orders", "customer", "lineitem"))
        derived = derive_borrowers(orders, customer, lineitem)
        cores = spark.sparkContext.defaultParallelism
        if orders.rdd.getNumPartitions() < cores:
            # A table in one row group is read, and would be written, by one task.
            derived = derived.repartition(cores, "id")
        derived.write.parquet(path)
        _written[slot] = path
    return spark.read.schema(BORROWER_SCHEMA).parquet(_written[slot])
