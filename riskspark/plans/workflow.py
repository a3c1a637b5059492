"""The four phases on files: profile, prepare, train, score. Each reads what the one before wrote."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.operators import explain, metrics, models, policy, profile, report, trees
from riskspark.operators.clean import check_threshold
from riskspark.operators.scale import robust_scale_apply, robust_scale_fit, scale_values
from riskspark.plans.pipeline import (
    SCALED, SCALED_COLS, Artifacts, fit_medians, score_applications, set_aside, split_features, train_rows,
)
from riskspark.schema import FEATURE_COLS, ID, LABEL, RAW_FEATURES
from riskspark.session import materialize
from riskspark.sources import applications as io
from riskspark.sources import artifacts

PREPARE, TRAIN = "prepare", "train"


def profile_reports(raw: DataFrame) -> dict[str, DataFrame]:
    """Every profiling report of the raw table, by name."""
    numeric = [LABEL, *RAW_FEATURES]
    corr = profile.corr_matrix(raw, numeric)
    return {
        "shape": profile.table_shape(raw),
        "duplicates": profile.duplicate_count(raw),
        "columns": profile.column_profile(raw, numeric),
        "class_balance": profile.class_balance(raw),
        "missing": profile.missing_report(raw, numeric),
        "outliers": profile.iqr_outliers(raw),
        "extremes": profile.extreme_values(raw),
        "histograms": profile.class_histogram(raw, RAW_FEATURES),
        "correlation": profile.corr_lower_triangle(corr),
        "target_correlation": profile.target_corr_rank(corr),
        "class_compare": profile.class_compare(raw),
        "income_boxes": profile.box_stats(raw, "monthly_income"),
        "utilization_boxes": profile.box_stats(raw, "revolving_utilization"),
    }


def run_profile(raw: DataFrame, out: str) -> None:
    for name, report in profile_reports(raw).items():
        report.write.mode("overwrite").parquet(f"{out}/profile/{name}")


def run_prepare(raw: DataFrame, out: str) -> None:
    """Medians, scaler and the scaled splits, committed as a new version."""
    spark, folder = raw.sparkSession, artifacts.new_folder(out, PREPARE)
    medians = fit_medians(raw)
    medians.write.parquet(f"{folder}/medians")
    rows = materialize(split_features(raw, medians), "features")
    io.save_scaler(robust_scale_fit(train_rows(rows)), f"{folder}/scaler")
    fitted = scale_values(io.load_scaler(spark, f"{folder}/scaler"))
    io.write_splits(robust_scale_apply(rows, fitted, SCALED), f"{folder}/splits")
    artifacts.commit(spark, out, PREPARE, folder, ["medians", "scaler", "splits"])


def run_train(
    spark: SparkSession, out: str, n_trials: int = 50, space: Mapping[str, tuple] = models.SEARCH_SPACE,
    balanced_rounds: int = models.BALANCED_BOOST.rounds, seed: int = models.SEED,
) -> DataFrame:
    """Train the three models, compare them, pick the threshold on validation, store everything as a new version."""
    source, folder = artifacts.newest(spark, out, PREPARE), artifacts.new_folder(out, TRAIN)
    splits = source.path("splits")
    train, val = (io.read_splits(spark, splits, s) for s in ("train", "val"))
    held_out = io.read_splits(spark, splits).where("split in ('val', 'test')")
    trials, best = models.hyperparam_search(train, val, SCALED_COLS, n_trials, space, seed)
    trials.write.parquet(f"{folder}/trials")
    tuned = models.train_gbt(train, val, SCALED_COLS, replace(best), seed)
    fitted = {
        "logreg": models.train_logreg(train, SCALED_COLS),
        "gbt": tuned.model,
        "gbt_balanced": models.train_gbt_balanced(train, val, SCALED_COLS, balanced_rounds, seed).model,
    }
    scored = None
    for name, model in fitted.items():
        part = models.score_model(model, held_out).select(
            F.lit(name).alias("model"), ID, LABEL, "split", "margin", "prob"
        )
        scored = part if scored is None else scored.unionByName(part)
    scored.write.partitionBy("model", "split").parquet(f"{folder}/scores")
    scored = spark.read.parquet(f"{folder}/scores")
    comparison = metrics.model_comparison(scored, score="margin")
    io.save_metrics(comparison, f"{folder}/metrics")
    validation = scored.where("model = 'gbt' and split = 'val'")
    sweep = metrics.threshold_sweep(validation)
    sweep.write.parquet(f"{folder}/sweep")
    io.save_threshold(metrics.best_threshold(sweep), f"{folder}/threshold")
    io.save_model(tuned.model, f"{folder}/model")
    tables, files = ["trials", "scores", "sweep", "learning_curve", "confusion", "curves"], ["metrics", "threshold", "model"]
    rows = io.read_splits(spark, splits).where("split in ('train', 'val')")
    models.learning_curve(PipelineModel(tuned.full.stages), rows, SCALED_COLS).write.parquet(f"{folder}/learning_curve")
    test = scored.where("model = 'gbt' and split = 'test'")
    metrics.confusion_matrix(test, io.load_threshold(spark, f"{folder}/threshold")).write.parquet(f"{folder}/confusion")
    metrics.roc_curve(test, score="margin").write.parquet(f"{folder}/curves")
    artifacts.commit(spark, out, TRAIN, folder, tables, files, uses=source.folder)
    return spark.read.option("header", True).option("inferSchema", True).csv(f"{folder}/metrics")


def load_artifacts(spark: SparkSession, out: str) -> tuple[Artifacts, PipelineModel]:
    """The newest committed model with the medians and the scaler of the very version it was trained on."""
    trained = artifacts.newest(spark, out, TRAIN)
    source = artifacts.by_folder(spark, out, PREPARE, trained.uses)
    fitted = Artifacts(
        medians=artifacts.read_table(spark, source, "medians", verify=True),
        scale=scale_values(artifacts.read_table(spark, source, "scaler", verify=True)),
        threshold=io.load_threshold(spark, artifacts.verify_files(spark, trained, "threshold")),
    )
    return fitted, io.load_model(artifacts.verify_files(spark, trained, "model"))


def score_with_model(
    applications: DataFrame, fitted: Artifacts, model: PipelineModel, threshold: float | None = None
) -> DataFrame:
    """Decisions of the stored model, with the stored threshold unless another is given."""
    chosen = fitted if threshold is None else replace(fitted, threshold=check_threshold(threshold))
    scored = score_applications(applications, chosen, lambda df: models.score_model(model, df))
    return policy.decision_text(scored)


def explain_with_model(applications: DataFrame, fitted: Artifacts, model: PipelineModel) -> DataFrame:
    """Scored applications with the contributions behind each score."""
    spark = applications.sparkSession
    scored = score_with_model(applications, fitted, model)
    found = trees.load_trees(model, spark)
    keep = [ID, "margin", "prob", "decision", "band"]
    return trees.explain_trees(scored, found, SCALED_COLS, FEATURE_COLS, keep, shown=FEATURE_COLS)


def explanation_reports(explained: DataFrame, threshold: float) -> dict[str, DataFrame]:
    return {
        "importance": explain.importance_rank(explained),
        "beeswarm": explain.beeswarm_data(explained),
        "dependence": explain.dependence_data(explained),
        "cases": explain.pick_cases(explained, threshold),
    }


def run_score(applications: DataFrame, out: str, to: str, threshold: float | None = None) -> None:
    """Decisions of the newest model below `to`, the applications set aside, and the report of every scored one:
    its strongest factors, all indicators, margin before and after the contributions; and the explanation reports."""
    spark = applications.sparkSession
    fitted, model = load_artifacts(spark, out)
    score_with_model(applications, fitted, model, threshold).write.mode("overwrite").parquet(f"{to}/decisions")
    set_aside(applications, fitted).write.mode("overwrite").parquet(f"{to}/set_aside")
    explained = materialize(explain_with_model(applications, fitted, model), "explained")
    expected = trees.expected_margin(trees.load_trees(model, spark))
    reports = {
        "reasons": report.reason_codes(explained),
        "indicators": report.indicator_table(explained),
        "baseline": explain.baseline_vs_final(explained, expected).drop("contributions"),
        **explanation_reports(explained, fitted.threshold if threshold is None else threshold),
    }
    for name, rows in reports.items():
        rows.write.mode("overwrite").parquet(f"{to}/reports/{name}")
