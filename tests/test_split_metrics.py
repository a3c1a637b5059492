import numpy as np
import pytest
from pyspark.sql import functions as F

from riskspark.operators import metrics, ordered, policy, split
from riskspark.plans import scorecard
from riskspark.sources.borrowers import borrowers


def scored(spark, rows):
    return spark.createDataFrame(rows, "prob double, target int").withColumn("score", F.col("prob"))


EDGE = [(.9, 1), (.8, 0), (.7, 1), (.7, 0), (.2, 0), (.1, 1)]


def test_edge_scores(spark):
    df = scored(spark, EDGE)
    assert metrics.roc_auc(df).first()[0] == pytest.approx(0.5)
    assert metrics.average_precision(df).first()[0] == pytest.approx((1 / 3) * (1 + 2 / 4 + 3 / 6))
    c = metrics.confusion_matrix(df).first()
    assert (c["tp"], c["fp"], c["fn"], c["tn"]) == (2, 2, 1, 1)


def test_single_class(spark):
    df = scored(spark, [(.1, 0), (.2, 0)])
    assert metrics.roc_auc(df).first()[0] is None
    sweep = metrics.threshold_sweep(df)
    assert sweep.count() == 80 and sweep.agg(F.max("f1")).first()[0] == 0.0


def test_auc_is_rank_based(spark, sf):
    card = scorecard.card_a(borrowers(spark, sf))
    a = metrics.roc_auc(card, score="margin").first()[0]
    b = metrics.roc_auc(card.withColumn("e", F.exp("margin")), score="e").first()[0]
    assert a == pytest.approx(b)


@pytest.mark.parametrize("buckets", [2, 7, 64])
def test_prefix_equals_one_window(spark, sf, buckets):
    card = scorecard.card_a(borrowers(spark, sf)).withColumn("g", F.col("id") % 3)
    got = ordered.ordered_prefix(card, "score", ["target"], ["g"], buckets).toPandas()
    pdf = card.toPandas().groupby(["g", "score"])["target"].sum().reset_index()
    pdf["before"] = pdf.groupby("g")["target"].cumsum() - pdf["target"]
    both = got.merge(pdf, on=["g", "score"])
    assert len(both) == len(got) == len(pdf)
    assert (both["before"] == both["target_before"]).all()


def test_prefix_with_a_hot_key(spark):
    df = spark.range(9000).select(F.when(F.col("id") < 3000, 5).otherwise(F.col("id")).alias("k"), F.lit(1).alias("n"))
    got = ordered.ordered_prefix(df, "k", ["n"], buckets=16).toPandas().sort_values("k")
    assert got.iloc[0]["n"] == 3000 and got.iloc[-1]["n_before"] == 8999


@pytest.mark.parametrize("order_rows", [5, 100_000])
def test_split_matches_a_full_ranking(spark, sf, order_rows):
    df = borrowers(spark, sf).select("id", "target")
    sizes = ordered.class_sizes(df, "target")
    ranks = {c: (int(.2 * n), int(.4 * n)) for c, n in sizes.items()}
    cuts = ordered.hash_cuts(df, "target", ranks, "id", 42, sizes, order_rows=order_rows)
    pdf = df.withColumn("h", ordered.hash_key("id", 42)).toPandas().sort_values(["target", "h", "id"])
    for (c, r), hit in cuts.items():
        row = pdf[pdf["target"] == c].iloc[r - 1]
        assert hit == (row["h"], row["id"])


def test_split_shares_and_plan(spark, sf):
    df = split.stratified_split(borrowers(spark, sf).select("id", "target"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    got = {(r["split"], r["target"]): r["n"] for r in df.groupBy("split", "target").agg(F.count("*").alias("n")).collect()}
    for c in (0, 1):
        total = sum(got[s, c] for s in ("train", "val", "test"))
        assert got["test", c] == int(.2 * total) and got["val", c] == int(.4 * total) - int(.2 * total)


def test_undersample_ratio(spark, sf):
    df = split.random_undersample(borrowers(spark, sf).select("id", "target"))
    n = {r["target"]: r["count"] for r in df.groupBy("target").count().collect()}
    assert n[0] == 2 * n[1]


def test_sweep_matches_brute_force(spark, sf):
    card = scorecard.card_a(borrowers(spark, sf))
    pdf = card.toPandas()
    got = metrics.threshold_sweep(card).toPandas().sort_values("k")
    grid = np.linspace(.1, .9, 80)
    assert np.array_equal(got["threshold"], grid)
    assert got["tp"].tolist() == [int(((pdf.prob >= t) & (pdf.target == 1)).sum()) for t in grid]
    assert got["fp"].tolist() == [int(((pdf.prob >= t) & (pdf.target == 0)).sum()) for t in grid]


def test_grid_values_themselves_reach_their_cut(spark):
    grid = np.linspace(.1, .9, 80)
    values = sorted(set(grid) | {np.nextafter(g, 0) for g in grid} | {np.nextafter(g, 1) for g in grid} | {0.0, 1.0})
    df = spark.createDataFrame([(float(v),) for v in values], "p double")
    for r in df.select("p", metrics.grid_count(F.col("p"), .1, .9, 80).alias("n")).collect():
        assert r["n"] == int((grid <= r["p"]).sum())


def test_policy_matches_brute_force(spark, sf):
    card = scorecard.card_a(borrowers(spark, sf))
    extra = [(float(c / 100), i % 2) for i, c in enumerate(range(5, 105))] + [(c / 100 + .1, 0) for c in range(10, 91)]
    rows = card.select("prob", "target").unionByName(spark.createDataFrame(extra, "prob double, target int"))
    pdf = rows.toPandas()
    got = policy.policy_simulation(rows, 0.5354).toPandas()
    assert len(got) == 81 and got.loc[got["recommended"], "cut"].tolist() == [.54]
    for _, r in got.iterrows():
        ok, no = pdf.prob < r["cut"], pdf.prob > r["cut"] + .1
        assert (r["approve"], r["reject"]) == (ok.sum(), no.sum())
        assert r["review"] == len(pdf) - ok.sum() - no.sum()
        assert r["good_rejected"] == ((pdf.target == 0) & no).sum()


def test_thinned_curve_keeps_its_ends(spark, sf):
    card = scorecard.card_a(borrowers(spark, sf))
    full, thin = (metrics.roc_curve(card, max_points=m).toPandas().sort_values("tpr") for m in (None, 50))
    assert 40 <= len(thin) <= 60
    assert thin[["fpr", "tpr"]].max().tolist() == full[["fpr", "tpr"]].max().tolist() == [1.0, 1.0]


def test_golden_metrics(spark):
    card = scorecard.card_a(borrowers(spark, "/root/testdata/sf0.01"))
    assert metrics.roc_auc(card).first()[0] == pytest.approx(0.73771840, abs=1e-8)
    assert metrics.average_precision(card).first()[0] == pytest.approx(0.20030513, abs=1e-8)
    best = metrics.best_threshold(metrics.threshold_sweep(card)).first()
    assert (best["k"], best["tp"], best["fp"], best["fn"]) == (44, 416, 1552, 614)


def test_rows_without_a_label_are_split_and_not_resampled(spark):
    df = spark.range(1_000).select("id", F.when(F.col("id") % 10 != 0, (F.col("id") % 3 == 0).cast("int")).alias("target"))
    got = {(r["target"], r["split"]): r["count"] for r in split.stratified_split(df).groupBy("target", "split").count().collect()}
    assert [got[None, s] for s in ("test", "val", "train")] == [20, 20, 60]
    assert {c for c, _ in got} == {None, 0, 1} and sum(got.values()) == 1_000
    kept = {r["target"]: r["count"] for r in split.random_undersample(df, ratio=1.0).groupBy("target").count().collect()}
    assert kept == {0: 300, 1: 300}
    assert split.random_undersample(df.where("target is null")).count() == 0


def test_scores_that_are_no_numbers_are_left_out_of_ranks(spark):
    rows = [(1, 0.9), (0, 0.1), (1, float("nan")), (0, float("nan")), (0, None), (1, float("inf")), (0, float("-inf"))]
    df = spark.createDataFrame(rows, "target int, score double")
    assert metrics.roc_auc(df).first()["auc"] == 1.0
    many = spark.range(60_000).select((F.col("id") % 2).cast("int").alias("target"), F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.rand(3)).alias("score")).cache()
    pdf = many.toPandas()
    ranks = pdf["score"].rank()
    pos = pdf["target"] == 1
    want = (ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    assert metrics.roc_auc(many).first()["auc"] == pytest.approx(want, abs=1e-12)
    assert metrics.roc_auc(many, buckets=5_000).first()["auc"] == pytest.approx(want, abs=1e-12)
