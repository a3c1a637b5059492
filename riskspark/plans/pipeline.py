"""The phases end to end: prepare and split, score, decide."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.functions.features import engineer_features
from riskspark.operators.clean import AGE_HIGH, AGE_LOW, apply_cleaning, filter_age, fit_income_medians, prepare
from riskspark.operators.policy import decide, decision_margin, risk_band, risk_percent
from riskspark.operators.scale import robust_scale_apply, robust_scale_fit, scale_values
from riskspark.operators.split import stratified_split
from riskspark.plans import scorecard
from riskspark.schema import FEATURE_COLS, ID, LABEL, check_contract
from riskspark.session import materialize, scratch_path
from riskspark.sources.applications import load_scaler, read_splits, save_scaler, write_splits
from riskspark.sources.borrowers import borrowers

SCALED = "__scaled"
SCALED_COLS = [c + SCALED for c in FEATURE_COLS]


@dataclass(frozen=True)
class Artifacts:
    """What serving needs from training: small tables and a threshold."""

    medians: DataFrame
    scale: dict[str, tuple[float, float]]
    threshold: float = scorecard.THRESHOLD


def select_features(df: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    return check_contract(df.select(ID, *FEATURE_COLS, LABEL, *extra))


def featured(raw: DataFrame, medians: DataFrame) -> DataFrame:
    return engineer_features(apply_cleaning(raw, medians))


def fit_medians(raw: DataFrame) -> DataFrame:
    """The four fitted medians as a stored table, so applying them does not refit them."""
    return materialize(fit_income_medians(prepare(raw)), "medians")


def split_features(raw: DataFrame, medians: DataFrame | None = None) -> DataFrame:
    """Cleaned, featured, split; not yet scaled.

    The cut hashes depend on id, label and age only, so they are found on the filtered raw rows.
    """
    medians = fit_medians(raw) if medians is None else medians
    return select_features(featured(stratified_split(filter_age(raw)), medians), ("split",))


def train_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col("split") == "train")


def fit_artifacts(raw: DataFrame, threshold: float = scorecard.THRESHOLD) -> Artifacts:
    medians = fit_medians(raw)
    scale = robust_scale_fit(train_rows(split_features(raw, medians)))
    return Artifacts(medians, scale_values(scale), threshold)


_prepared: dict[tuple[str, str], tuple[str, Artifacts]] = {}


def _training(spark: SparkSession, sf_dir: str) -> tuple[str, Artifacts]:
    """Splits and serving artifacts, fitted and written once per application."""
    slot = (spark.sparkContext.applicationId, sf_dir)
    if slot not in _prepared:
        raw = borrowers(spark, sf_dir)
        medians = fit_medians(raw)
        rows = materialize(split_features(raw, medians), "features")
        path, scaler = scratch_path(spark, "splits"), scratch_path(spark, "scaler")
        save_scaler(robust_scale_fit(train_rows(rows)), scaler)
        artifacts = Artifacts(medians, scale_values(load_scaler(spark, scaler)))
        write_splits(robust_scale_apply(rows, artifacts.scale, SCALED), path)
        _prepared[slot] = path, artifacts
    return _prepared[slot]


def prepared(spark: SparkSession, sf_dir: str, split: str | None = None) -> DataFrame:
    """The boundary between feature engineering and modelling: features, scaled features, label
    and split, written once per application, one folder per split."""
    return read_splits(spark, _training(spark, sf_dir)[0], split)


def stored_artifacts(spark: SparkSession, sf_dir: str) -> Artifacts:
    """What serving needs, as the training phase stored it: nothing is fitted while serving."""
    return _training(spark, sf_dir)[1]


def score_scaled_card(df: DataFrame, suffix: str = SCALED) -> DataFrame:
    return scorecard.with_score(
        df, scorecard.linear_margin(scorecard.SCALED_WEIGHTS, scorecard.SCALED_INTERCEPT, suffix)
    )


def violations(cols: Sequence[str] = tuple(FEATURE_COLS)) -> Column:
    """The features a row can't be scored without, by name: those that are null or no number."""
    missing = [F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), F.lit(c)) for c in cols]
    return F.array_compact(F.array(*missing))


def _served(raw: DataFrame, artifacts: Artifacts) -> DataFrame:
    """Features, scaled features and `violations` of every application of an admitted age."""
    scaled = robust_scale_apply(featured(raw, artifacts.medians), artifacts.scale, SCALED)
    return scaled.withColumn("violations", violations())


def score_applications(
    raw: DataFrame, artifacts: Artifacts, score: Callable[[DataFrame], DataFrame] = score_scaled_card
) -> DataFrame:
    """Features, scaling, score and decision of every application that can be scored, labelled or not.

    Only projections and one lookup of four medians, so batches and streams use the same plan. The others are
    in `set_aside`; together they are all applications.
    """
    rows = _served(raw, artifacts).where(F.size("violations") == 0).drop("violations")
    return with_decision(score(rows), artifacts.threshold)


def set_aside(raw: DataFrame, artifacts: Artifacts) -> DataFrame:
    """`(id, violations)` of the applications that get no score: missing features, or an age outside the limits."""
    lacking = _served(raw, artifacts).where(F.size("violations") > 0).select(ID, "violations")
    admitted = F.coalesce((F.col("age") > AGE_LOW) & (F.col("age") <= AGE_HIGH), F.lit(False))
    return lacking.unionByName(raw.where(~admitted).select(ID, F.array(F.lit("age")).alias("violations")))


def with_decision(scored: DataFrame, threshold: float) -> DataFrame:
    p = F.col("prob")
    return scored.withColumns({
        "decision": decide(p, threshold),
        "band": risk_band(p),
        "risk_pct": risk_percent(p),
        "margin_to_cut": decision_margin(p, threshold),
    })


def decision_overview(raw: DataFrame, threshold: float = scorecard.THRESHOLD) -> DataFrame:
    """Flagship question: how many applications per decision and band, and how many went bad?"""
    cleaned = featured(raw, fit_income_medians(prepare(raw)))
    scored = with_decision(scorecard.with_score(cleaned, scorecard.margin_a()), threshold)
    return scored.groupBy("decision", "band").agg(
        F.count("*").alias("n"), F.sum(LABEL).alias("bad"),
    ).select("decision", "band", "n", "bad", (F.col("bad") / F.col("n")).alias("bad_rate"))
