import math

from pyspark.sql import functions as F

from riskspark.functions import display, features as feat
from riskspark.operators import clean, policy, report


def column(spark, values, expr, kind="double"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("x"))).collect()]


def test_utilisation_bins_are_right_closed(spark):
    values = [-.02, -.01, 0.0, .3, .30001, .7, 1.0, 1.5, None]
    assert column(spark, values, feat.utilization_risk) == [None, None, 0, 0, 1, 1, 2, 3, None]


def test_strict_bins_raise(spark):
    import pytest
    with pytest.raises(Exception, match="outside the bins"):
        column(spark, [-1.0], lambda x: feat.utilization_risk(x, strict=True))


def test_age_groups_at_the_edges(spark):
    df = spark.createDataFrame([(a,) for a in (0, 1, 30, 31, 45, 46, 60, 61, 95, 100, 101, None)], "age int")
    got = [r["age_group"] for r in clean.bin_age_group(df).collect()]
    assert got == [None, "<30", "<30", "30-45", "30-45", "45-60", "45-60", "60+", "60+", "60+", None, None]


def test_credit_lines_round_half_even(spark):
    df = spark.createDataFrame([(1, 32), (3, 32), (5, 32), (8, 35)], "l int, a int")
    got = [r[0] for r in df.select(feat.credit_lines_per_age(F.col("l"), F.col("a"))).collect()]
    assert got == [0.0312, 0.0938, 0.1562, 0.2286]


def test_money_text_matches_printf(spark):
    values = [999.0, 999.5, 0.5, 1000.0, 1500.0, 2500.0, 999_999.0, 1e6, 5_050_000.0, 5_250_000.0, 1e9, 1.25e9, 1.5e12, 0.0]

    def expected(x):
        if x >= 1e9:
            return f"Rp {x / 1e9:.1f} M"
        if x >= 1e6:
            return f"Rp {x / 1e6:.1f} jt"
        if x >= 1e3:
            return f"Rp {x / 1e3:.0f} rb"
        return f"Rp {x:,.0f}"

    assert column(spark, values, display.format_currency) == [expected(v) for v in values]


def test_indicator_text(spark):
    rows = [("monthly_income", 312.5), ("debt_ratio", .355), ("ever_late", 1.0), ("ever_late", 0.0),
            ("log_income", math.log1p(312.5)), ("utilization_risk", 3.0), ("utilization_risk", 0.0), ("age", 35.0)]
    df = spark.createDataFrame(rows, "f string, v double")
    got = [r[0] for r in df.select(display.format_indicator(F.col("f"), F.col("v"))).collect()]
    assert got == ["Rp 5.0 jt", "35.5%", "Ya", "Tidak", "Rp 5.0 jt", "Kritis", "Aman", "35.00"]


def test_decision_edges(spark):
    t = 0.5
    over = t + 0.1
    values = [math.nextafter(t, 0), t, over, math.nextafter(over, 1), None]
    assert column(spark, values, lambda p: policy.decide(p, t)) == ["approve", "review", "review", "reject", None]


def test_band_edges(spark):
    values = [math.nextafter(.35, 0), .35, math.nextafter(.55, 0), .55, None]
    assert column(spark, values, policy.risk_band) == ["low", "medium", "medium", "high", None]


def test_contribution_edges(spark):
    values = [-.0101, -.01, 0.0, .01, .0101]
    assert column(spark, values, report.contribution_class) == ["improves", "neutral", "neutral", "neutral", "worsens"]


def test_dictionary_falls_back(spark):
    df = spark.createDataFrame([("age",), ("weighted_late_score",), ("made_up_name",)], "feature string")
    got = {r["feature"]: (r["label"], r["hint"]) for r in report.feature_dictionary(df).collect()}
    assert got["age"] == ("Usia Pemohon", "—")
    assert got["made_up_name"] == ("Made Up Name", "—")
    assert got["weighted_late_score"][1].startswith("Semakin panjang")


def test_threshold_bounds():
    import pytest
    assert clean.check_threshold(0.5) == 0.5
    with pytest.raises(ValueError):
        clean.check_threshold(0.05)
