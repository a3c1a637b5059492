import numpy as np
import pytest
from pyspark.sql import functions as F

from riskspark.operators import clean, profile, quantiles, scale
from riskspark.plans.registry import NUMERIC
from riskspark.schema import BORROWER_SCHEMA, FEATURE_COLS, RAW_TO_NAME, check_contract
from riskspark.sources import applications as io
from riskspark.sources.borrowers import borrowers


def applicants(spark, rows):
    """Frame of applicants from (id, target, utilisation, age, income, dependents)."""
    full = [(i, t, u, a, 0, .4, m, 5, 0, 1, 0, d) for i, t, u, a, m, d in rows]
    return spark.createDataFrame(full, BORROWER_SCHEMA)


def test_group_without_income_takes_the_overall_median(spark):
    df = applicants(spark, [(1, 0, .1, 20, None, None), (2, 0, .2, 25, None, 1.0), (3, 0, .3, 40, 100.0, 2.0),
                            (4, 0, .4, 41, 300.0, 0.0), (5, 1, 9.0, 70, 900.0, 0.0), (6, 0, .1, 0, 5.0, 0.0),
                            (7, 0, .1, 96, 5.0, 0.0), (8, 0, .1, 95, None, 0.0), (9, 0, .1, None, 1.0, 0.0)])
    got = {r["id"]: r for r in clean.clean(df).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 8}
    assert got[1]["monthly_income"] == 300.0 and got[8]["monthly_income"] == 900.0
    assert got[1]["num_dependents"] == 0.0 and got[5]["revolving_utilization"] == 1.5


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(None,), (1.0,), (2.0,)], "revolving_utilization double")
    assert [r[0] for r in clean.clip_utilization(df).collect()] == [None, 1.0, 1.5]


def test_csv_reader_reads_missing_markers(spark, tmp_path):
    head = ",SeriousDlqin2yrs,RevolvingUtilizationOfUnsecuredLines,age,NumberOfTime30-59DaysPastDueNotWorse,DebtRatio," \
           "MonthlyIncome,NumberOfOpenCreditLinesAndLoans,NumberOfTimes90DaysLate,NumberRealEstateLoansOrLines," \
           "NumberOfTime60-89DaysPastDueNotWorse,NumberOfDependents"
    (tmp_path / "a.csv").write_text(head + "\n1,1,0.77,45,2,0.8,9120,13,0,6,0,2\n2,0,0.9,40,0,0.1,NA,4,0,0,0,\n")
    rows = io.read_applications_csv(spark, str(tmp_path)).orderBy("id").collect()
    assert rows[0]["monthly_income"] == 9120.0 and rows[0]["late_30_59"] == 2
    assert rows[1]["monthly_income"] is None and rows[1]["num_dependents"] is None


HEADERS = list(RAW_TO_NAME)


def csv_file(folder, headers, *rows):
    folder.mkdir()
    lines = [",".join(["", *headers]), *(",".join([str(k), *(str(r.get(h, 0)) for h in headers)]) for k, r in enumerate(rows))]
    (folder / "a.csv").write_text("\n".join(lines) + "\n")
    return str(folder)


def test_csv_is_read_by_name(spark, tmp_path):
    row = {h: k for k, h in enumerate(HEADERS)} | {"age": "40.0", "DebtRatio": "0.25"}
    same = [io.read_applications_csv(spark, csv_file(tmp_path / name, headers, row)).first()
            for name, headers in (("given", HEADERS), ("turned", HEADERS[::-1]))]
    assert same[0] == same[1] and same[0]["age"] == 40 and same[0]["debt_ratio"] == 0.25
    unlabelled = io.read_applications_csv(spark, csv_file(tmp_path / "new", HEADERS[1:], row)).first()
    assert unlabelled["target"] is None and unlabelled["debt_ratio"] == 0.25


@pytest.mark.parametrize("headers", [HEADERS[:-1], [*HEADERS, "extra"], [*HEADERS, "age"]])
def test_csv_with_other_columns_is_refused(spark, tmp_path, headers):
    with pytest.raises(ValueError, match="headers"):
        io.read_applications_csv(spark, csv_file(tmp_path / "bad", headers, {}))


def test_malformed_csv_rows_are_listed(spark, tmp_path):
    path = csv_file(tmp_path / "bad", HEADERS, {"age": "forty", "DebtRatio": "x"}, {"age": "40.5"}, {"MonthlyIncome": "NA"})
    got = {r["id"]: r["fields"] for r in io.malformed_applications(spark, path).collect()}
    assert got == {"0": ["age", "debt_ratio"], "1": ["age"]}
    rows = io.read_applications_csv(spark, path).orderBy("id").collect()
    assert [r["age"] for r in rows] == [None, None, 0]


def test_contract(spark):
    df = spark.createDataFrame([tuple(range(19))], ", ".join(f"`{c}` int" for c in FEATURE_COLS))
    check_contract(df)
    with pytest.raises(ValueError):
        check_contract(df.select(*reversed(FEATURE_COLS)))


def test_threshold_file_fallback(spark, tmp_path):
    assert io.load_threshold(spark, str(tmp_path / "missing")) == 0.5
    (tmp_path / "t.json").write_text('{"other": 1}')
    assert io.load_threshold(spark, str(tmp_path / "t.json")) == 0.5


@pytest.mark.parametrize("by", [[], ["target"]])
def test_narrowed_quantiles_equal_numpy(spark, sf, by):
    df = borrowers(spark, sf)
    cols, probs = ["age", "monthly_income", "late_90d", "revolving_utilization"], [0.0, 0.25, 0.5, 0.99, 1.0]
    got = quantiles.quantiles(df, cols, probs, by, order_rows=20).toPandas()
    pdf = df.toPandas()
    for _, r in got.iterrows():
        part = pdf if not by else pdf[pdf["target"] == r["target"]]
        assert r["value"] == pytest.approx(np.nanquantile(part[r["feature"]].astype(float), r["p"]), abs=1e-9)
    assert len(got) == len(cols) * len(probs) * (2 if by else 1)


def test_narrowing_survives_a_hot_value(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.col("id") / 100).alias("x"))
    got = quantiles.quantiles(df, ["x"], [.1, .3, .5, .9], order_rows=1).toPandas()
    x = df.toPandas()["x"]
    assert np.allclose(got.sort_values("p")["value"], np.quantile(x, [.1, .3, .5, .9]))


def test_quantiles_of_many_groups(spark):
    """5,000 groups and a null one, each by the same route; a small bound narrows the large ones."""
    rows = spark.range(40_000).select(
        F.when(F.col("id") % 5_001 < 5_000, F.col("id") % 5_001).alias("g"), ((F.col("id") * 7_919) % 1_009 / 8).alias("x")
    ).unionByName(spark.range(3_000).select(F.lit(1).cast("bigint").alias("g"), (F.col("id") / 7).alias("x")))
    got = quantiles.quantiles(rows, ["x"], [0.25, 0.5], ["g"], order_rows=100).toPandas()
    pdf = rows.toPandas()
    want = pdf.groupby("g", dropna=False)["x"].quantile([0.25, 0.5]).reset_index()
    assert len(got) == 2 * 5_001
    both = got.assign(g=got["g"].fillna(-1)).merge(want.assign(g=want["g"].fillna(-1)), left_on=["g", "p"], right_on=["g", "level_1"])
    assert len(both) == 2 * 5_001 and np.allclose(both["value"], both["x"])


def test_quantiles_skip_nan_and_order_infinities(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(x, y, None) for x, y in zip([nan, -inf, 1.0, 2.0, None, 3.0, inf, nan, 4.0], [nan, None] * 4 + [nan])]
    for bound in (1, 1_000):
        got = quantiles.quantiles(spark.createDataFrame(rows, "x double, y double, z int"), ["x", "y", "z"], [0.0, 0.1, 0.5, 0.9, 1.0], order_rows=bound)
        found = {(r["feature"], r["p"]): r["value"] for r in got.collect()}
        assert [found["x", p] for p in (0.0, 0.1, 0.5, 0.9, 1.0)] == [-inf, -inf, 2.5, inf, inf]
        assert [found[c, p] for c in "yz" for p in (0.0, 0.5, 1.0)] == [None] * 6
    empty = spark.createDataFrame([], "x double, g int")
    assert [tuple(r) for r in quantiles.quantiles(empty, ["x"], [0.5]).collect()] == [("x", 0.5, None)]
    assert quantiles.quantiles(empty, ["x"], [0.5], ["g"]).collect() == []


def test_zero_range_scales_by_one(spark):
    df = spark.createDataFrame([(0.0, float(i)) for i in range(9)] + [(5.0, 9.0)], "flat double, x double")
    params = scale.robust_scale_fit(df, ["flat", "x"])
    got = scale.robust_scale_apply(df, params).toPandas()
    assert got["flat"].tolist() == [0.0] * 9 + [5.0]
    assert got["x"].tolist() == pytest.approx(((np.arange(10) - 4.5) / 4.5).tolist())


def test_profile_with_nulls_duplicates_and_constants(spark):
    df = spark.createDataFrame(
        [(1, 1, None, 5, None), (2, 1, None, 5, None), (3, 2, 3.0, 5, None)], "id long, a int, b double, c int, d double"
    )
    assert profile.duplicate_count(df).first()[0] == 1
    for approx in (False, True):
        got = {r["column"]: r for r in profile.column_profile(df, ["a", "b", "c", "d"], approx).collect()}
        assert got["d"]["missing"] == 3 and got["d"]["unique"] == 0 and got["d"]["median"] is None
        assert got["c"]["min"] == got["c"]["max"] == 5.0 and got["b"]["missing_pct"] == 66.67


def test_histogram_matches_numpy(spark, sf):
    df = borrowers(spark, sf)
    pdf = df.toPandas()
    got = profile.class_histogram(df, ["age", "monthly_income", "late_90d"]).toPandas()
    for (feature, cls), part in got.groupby(["feature", "class"]):
        x = pdf.loc[pdf["target"] == cls, feature].dropna().astype(float)
        x = x[x <= x.quantile(.99)]
        n, edges = np.histogram(x, bins=40)
        density, _ = np.histogram(x, bins=40, density=True)
        part = part.sort_values("bin")
        assert part["n"].tolist() == n.tolist()
        assert np.allclose(part["lo"], edges[:-1]) and np.allclose(part["density"], density)


def test_correlation_matches_pandas(spark, sf):
    df = borrowers(spark, sf)
    expected = df.toPandas()[NUMERIC].corr()
    for r in profile.corr_matrix(df, NUMERIC).collect():
        assert r["r"] == pytest.approx(expected.loc[r["a"], r["b"]], abs=1e-9)


def test_box_whiskers_stay_inside_the_fences(spark):
    df = spark.createDataFrame([(0, float(v)) for v in [1, 2, 3, 4, 5, 6, 7, 8, 9, 100]] + [(1, 5.0), (1, 6.0)],
                               "target int, x double")
    got = profile.box_stats(df, "x", clip=1.0).where("class = 0").first()
    assert (got["lo"], got["hi"], got["med"]) == (1.0, 9.0, 5.5)


def test_bounds_rules(spark):
    df = applicants(spark, [(1, 0, .1, 17, 400.0, 11.0), (2, 0, 1.6, 30, None, None)])
    got = {r["id"]: r["violations"] for r in clean.input_bounds(df).collect()}
    assert got[1] == ["age", "num_dependents"] and got[2] == ["utilization_pct"]
