"""Every operator as a query over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.functions import display, features as feat
from riskspark.operators import (
    clean, explain, metrics, models, policy, profile, rebalance, report, scale, split, trees,
)
from riskspark.operators.quantiles import quantiles
from riskspark.plans import forest, pipeline, scorecard
from riskspark.schema import DERIVED_FEATURES, FEATURE_COLS, ID, LABEL, RAW_FEATURES, RAW_TO_NAME
from riskspark.session import materialize, scratch_path
from riskspark.sources import applications as io
from riskspark.sources.borrowers import borrowers
from riskspark.streaming.score_stream import read_application_stream, read_decisions, stream_score

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
NUMERIC = [LABEL, *RAW_FEATURES]
DECISION_COLS = ["id", "margin", "prob", "decision", "band", "risk_pct", "margin_to_cut"]


def query(key: str):
    def register(fn: Query) -> Query:
        QUERIES[key] = fn
        return fn

    return register


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round the doubles, so that two engines' last bits cannot differ; adding 0 drops a minus zero."""
    doubles = [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: feat.round_half_even(F.col(c), digits) + F.lit(0.0) for c in doubles})


# --- sources, sinks, contracts -------------------------------------------------------------


@query("borrowers")
def q_borrowers(spark, sf):
    return borrowers(spark, sf)


@query("flagship")
def q_flagship(spark, sf):
    return tidy(pipeline.decision_overview(borrowers(spark, sf)))


@query("src_applications_csv")
def q_csv(spark, sf):
    path = scratch_path(spark, "applications-csv")
    io.write_applications_csv(borrowers(spark, sf), path)
    return io.read_applications_csv(spark, path)


def _rewritten_csv(spark, sf, columns) -> str:
    """Applications as a file with these columns, under the raw headers, after the id."""
    path = scratch_path(spark, "applications-csv")
    raw_names = {name: raw for raw, name in RAW_TO_NAME.items()}
    rows = borrowers(spark, sf).select("id", *columns).withColumnsRenamed(raw_names)
    rows.write.option("header", True).option("nullValue", "NA").csv(path)
    return path


@query("src_csv_other_order")
def q_csv_other_order(spark, sf):
    return io.read_applications_csv(spark, _rewritten_csv(spark, sf, reversed(RAW_TO_NAME.values())))


@query("src_csv_unlabelled")
def q_csv_unlabelled(spark, sf):
    return io.read_applications_csv(spark, _rewritten_csv(spark, sf, [n for n in RAW_TO_NAME.values() if n != "target"]))


@query("rename_columns")
def q_rename(spark, sf):
    raw = borrowers(spark, sf).withColumnsRenamed({name: raw for raw, name in RAW_TO_NAME.items()})
    return io.rename_columns(raw)


def _written_splits(spark, sf) -> str:
    path = scratch_path(spark, "sink-splits")
    io.write_splits(pipeline.split_features(borrowers(spark, sf)), path)
    return path


@query("sink_splits")
def q_sink_splits(spark, sf):
    return tidy(io.read_splits(spark, _written_splits(spark, sf)))


@query("src_splits")
def q_src_splits(spark, sf):
    return tidy(io.read_splits(spark, _written_splits(spark, sf), "test"))


@query("select_features")
def q_select_features(spark, sf):
    raw = borrowers(spark, sf)
    return tidy(pipeline.select_features(pipeline.featured(raw, clean.fit_income_medians(clean.prepare(raw)))))


@query("save_scaler")
def q_save_scaler(spark, sf):
    path = scratch_path(spark, "scaler")
    io.save_scaler(scale.robust_scale_fit(pipeline.train_rows(pipeline.split_features(borrowers(spark, sf)))), path)
    return tidy(io.load_scaler(spark, path))


@query("save_threshold")
def q_save_threshold(spark, sf):
    path = scratch_path(spark, "threshold")
    io.save_threshold(metrics.best_threshold(metrics.threshold_sweep(_card_splits(spark, sf, "val"))), path)
    value = io.load_threshold(spark, path)
    return spark.read.schema("best_threshold double, selection_rule string").json(path).withColumn(
        "loaded", F.lit(value)
    )


@query("sink_metrics")
def q_sink_metrics(spark, sf):
    path = scratch_path(spark, "metrics")
    io.save_metrics(q_model_comparison(spark, sf), path)
    schema = "model string, split string, auc_roc double, f1_weighted double, f1_minority double, ap double"
    return spark.read.schema(schema).option("header", True).csv(path)


@query("input_bounds")
def q_input_bounds(spark, sf):
    checked = clean.input_bounds(borrowers(spark, sf))
    return checked.select(
        ID, F.size("violations").alias("n_violations"), F.array_join("violations", ",").alias("violations")
    )


# --- cleaning ------------------------------------------------------------------------------


@query("filter_age")
def q_filter_age(spark, sf):
    return clean.filter_age(borrowers(spark, sf))


@query("clip_utilization")
def q_clip(spark, sf):
    return clean.clip_utilization(borrowers(spark, sf)).select(ID, "revolving_utilization")


@query("bin_age_group")
def q_bin(spark, sf):
    return clean.bin_age_group(borrowers(spark, sf)).select(ID, "age", "age_group")


@query("group_median")
def q_group_median(spark, sf):
    return tidy(clean.group_median(clean.prepare(borrowers(spark, sf))))


@query("global_median")
def q_global_median(spark, sf):
    return tidy(clean.global_median(clean.prepare(borrowers(spark, sf))))


@query("impute_group_median")
def q_impute_group(spark, sf):
    rows = clean.prepare(borrowers(spark, sf))
    return tidy(clean.impute_group_median(rows, clean.fit_income_medians(rows)).select(ID, "monthly_income"))


@query("impute_constant")
def q_impute_constant(spark, sf):
    return clean.impute_constant(borrowers(spark, sf), {"num_dependents": 0}).select(ID, "num_dependents")


@query("drop_helper")
def q_drop_helper(spark, sf):
    return clean.drop_helper(clean.prepare(borrowers(spark, sf)))


@query("cleaning_audit")
def q_audit(spark, sf):
    return clean.cleaning_audit(borrowers(spark, sf))


@query("filter_by_class")
def q_by_class(spark, sf):
    return clean.filter_by_class(borrowers(spark, sf), 1)


@query("drop_nulls_col")
def q_drop_nulls(spark, sf):
    return clean.drop_nulls_col(borrowers(spark, sf), "monthly_income")


@query("filter_metrics_split")
def q_filter_metrics(spark, sf):
    return metrics.filter_metrics_split(q_model_comparison(spark, sf))


# --- scalar features -----------------------------------------------------------------------


def cleaned(spark, sf) -> DataFrame:
    return clean.clean(borrowers(spark, sf))


def _feature_query(key: str, name: str):
    @query(key)
    def run(spark, sf):
        return tidy(feat.engineer_features(cleaned(spark, sf)).select(ID, name))


for _key, _name in {
    "f_total_late": "total_late_payments", "f_weighted_late": "weighted_late_score",
    "f_income_per_dependent": "income_per_dependent", "f_monthly_debt": "monthly_debt",
    "f_dti_adjusted": "dti_adjusted", "f_utilization_risk": "utilization_risk", "f_ever_late": "ever_late",
    "f_credit_lines_per_age": "credit_lines_per_age", "f_log_income": "log_income",
}.items():
    _feature_query(_key, _name)


@query("engineer_features")
def q_engineer(spark, sf):
    return tidy(feat.engineer_features(cleaned(spark, sf)).select(ID, *DERIVED_FEATURES))


@query("inv_log_income")
def q_inv_log(spark, sf):
    income = feat.inv_log_income(feat.log_income(F.col("monthly_income")))
    return tidy(borrowers(spark, sf).select(ID, income.alias("income")))


@query("currency_convert")
def q_currency(spark, sf):
    idr = display.convert_currency(F.col("monthly_income"))
    return tidy(borrowers(spark, sf).select(
        ID, idr.alias("idr"), display.convert_currency(idr, "idr_to_usd").alias("usd")
    ), 4)


@query("format_currency")
def q_format_currency(spark, sf):
    income = F.col("monthly_income")
    return borrowers(spark, sf).select(
        ID,
        display.format_currency(display.convert_currency(income)).alias("income_idr"),
        display.format_currency(income).alias("as_units"),
        display.format_currency(income * 1e6).alias("as_millions"),
    )


@query("percent_of_limit")
def q_percent(spark, sf):
    pct = display.convert_percent(F.col("revolving_utilization"))
    return tidy(borrowers(spark, sf).select(ID, pct.alias("pct"), display.convert_percent(pct, "to_share").alias("share")))


# --- profiling -----------------------------------------------------------------------------


@query("table_shape")
def q_shape(spark, sf):
    return profile.table_shape(borrowers(spark, sf))


@query("duplicate_count")
def q_duplicates(spark, sf):
    return profile.duplicate_count(borrowers(spark, sf))


@query("column_profile")
def q_profile(spark, sf):
    return tidy(profile.column_profile(borrowers(spark, sf), NUMERIC))


@query("class_balance")
def q_balance(spark, sf):
    return tidy(profile.class_balance(borrowers(spark, sf)))


@query("missing_report")
def q_missing(spark, sf):
    return profile.missing_report(borrowers(spark, sf), NUMERIC)


@query("quantile")
def q_quantile(spark, sf):
    rows = borrowers(spark, sf)
    probs = [0.01, 0.25, 0.5, 0.75, 0.95, 0.99]
    return tidy(quantiles(rows, RAW_FEATURES, probs, by=[LABEL]))


@query("iqr_outliers")
def q_iqr(spark, sf):
    return tidy(profile.iqr_outliers(borrowers(spark, sf)))


@query("extreme_values")
def q_extreme(spark, sf):
    return tidy(profile.extreme_values(borrowers(spark, sf)))


@query("class_histogram")
def q_histogram(spark, sf):
    return tidy(profile.class_histogram(borrowers(spark, sf), RAW_FEATURES), 9)


@query("class_histogram_derived")
def q_histogram_derived(spark, sf):
    rows = pipeline.featured(borrowers(spark, sf), pipeline.fit_medians(borrowers(spark, sf)))
    return tidy(profile.class_histogram(rows, profile.DERIVED_HISTOGRAMS), 9)


@query("corr_matrix")
def q_corr(spark, sf):
    return tidy(profile.corr_matrix(borrowers(spark, sf), NUMERIC).select("a", "b", "r"), 8)


@query("corr_lower_triangle")
def q_corr_lower(spark, sf):
    corr = profile.corr_matrix(borrowers(spark, sf), NUMERIC)
    return tidy(profile.corr_lower_triangle(corr).select("a", "b", "r"), 8)


@query("target_corr_rank")
def q_corr_rank(spark, sf):
    return tidy(profile.target_corr_rank(profile.corr_matrix(borrowers(spark, sf), NUMERIC)), 8)


@query("class_compare")
def q_compare(spark, sf):
    return tidy(profile.class_compare(borrowers(spark, sf)))


@query("box_stats")
def q_box(spark, sf):
    return tidy(profile.box_stats(borrowers(spark, sf), "monthly_income"))


@query("box_stats_utilization")
def q_box_utilization(spark, sf):
    return tidy(profile.box_stats(borrowers(spark, sf), "revolving_utilization"))


@query("split_summary")
def q_split_summary(spark, sf):
    return tidy(split.split_summary(split.stratified_split(clean.filter_age(borrowers(spark, sf)))))


@query("prevalence")
def q_prevalence(spark, sf):
    return tidy(metrics.prevalence(borrowers(spark, sf)), 9)


# --- split, rebalance, scale ---------------------------------------------------------------


@query("stratified_split")
def q_split(spark, sf):
    return split.stratified_split(borrowers(spark, sf).select(ID, LABEL))


@query("random_undersample")
def q_undersample(spark, sf):
    return split.random_undersample(pipeline.prepared(spark, sf, "train").select(ID, LABEL))


@query("robust_scale_fit")
def q_scale_fit(spark, sf):
    return tidy(scale.robust_scale_fit(pipeline.train_rows(pipeline.split_features(borrowers(spark, sf)))))


@query("robust_scale_apply")
def q_scale_apply(spark, sf):
    rows = pipeline.split_features(borrowers(spark, sf))
    return tidy(scale.robust_scale_apply(rows, scale.robust_scale_fit(pipeline.train_rows(rows))))


# --- scoring and metrics on the frozen cards -----------------------------------------------


def card(spark, sf) -> DataFrame:
    return scorecard.card_a(borrowers(spark, sf))


def _card_splits(spark, sf, which: str | None = None) -> DataFrame:
    rows = split.stratified_split(clean.filter_age(borrowers(spark, sf)))
    scored = scorecard.with_score(rows, scorecard.margin_a())
    return scored if which is None else scored.where(F.col("split") == which)


@query("score")
def q_score(spark, sf):
    return tidy(card(spark, sf))


@query("roc_auc")
def q_auc(spark, sf):
    return tidy(metrics.roc_auc(card(spark, sf)), 8)


@query("average_precision")
def q_ap(spark, sf):
    return tidy(metrics.average_precision(card(spark, sf)), 8)


@query("roc_curve")
def q_roc(spark, sf):
    return tidy(metrics.roc_curve(card(spark, sf)))


@query("pr_curve")
def q_pr(spark, sf):
    return tidy(metrics.pr_curve(card(spark, sf)))


@query("confusion_matrix")
def q_confusion(spark, sf):
    return metrics.confusion_matrix(card(spark, sf))


@query("precision_recall_f1")
def q_prf(spark, sf):
    return tidy(metrics.precision_recall_f1(metrics.confusion_matrix(card(spark, sf))))


@query("f1_weighted")
def q_f1w(spark, sf):
    return tidy(metrics.f1_weighted(metrics.confusion_matrix(card(spark, sf))))


@query("model_comparison")
def q_model_comparison(spark, sf):
    rows = split.stratified_split(clean.filter_age(borrowers(spark, sf))).where("split in ('val', 'test')")
    # One scan: each row yields its score under both cards.
    long = rows.select(ID, LABEL, "split", F.inline(F.array(
        F.struct(F.lit("card_a").alias("model"), scorecard.margin_a().alias("margin")),
        F.struct(F.lit("card_b").alias("model"), scorecard.margin_b().alias("margin")),
    )))
    return metrics.model_comparison(scorecard.with_score(long, F.col("margin")))


@query("threshold_sweep")
def q_sweep(spark, sf):
    return tidy(metrics.threshold_sweep(card(spark, sf)))


@query("best_threshold")
def q_best(spark, sf):
    return tidy(metrics.best_threshold(metrics.threshold_sweep(card(spark, sf))))


# --- explanation ---------------------------------------------------------------------------


def explained(spark, sf, part: str | None = "test") -> DataFrame:
    """Rows of one split (None: every application) with linear contributions of the scaled card, means taken on the training rows."""
    means = explain.feature_means(pipeline.prepared(spark, sf, "train"), suffix=pipeline.SCALED)
    scored = pipeline.score_scaled_card(pipeline.prepared(spark, sf, part))
    return explain.explain_linear(scored, scorecard.SCALED_WEIGHTS, means, pipeline.SCALED, digits=6)


@query("sample_for_explain")
def q_sample(spark, sf):
    return explain.sample_for_explain(pipeline.prepared(spark, sf, "test").select(ID, LABEL))


@query("explain_linear")
def q_explain_linear(spark, sf):
    return tidy(explain.to_long(explained(spark, sf)))


@query("importance_rank")
def q_importance(spark, sf):
    return tidy(explain.importance_rank(explained(spark, sf)))


@query("beeswarm_data")
def q_beeswarm(spark, sf):
    return tidy(explain.beeswarm_data(explained(spark, sf)))


@query("dependence_data")
def q_dependence(spark, sf):
    return tidy(explain.dependence_data(explained(spark, sf)))


@query("pick_cases")
def q_cases(spark, sf):
    return tidy(explain.pick_cases(explained(spark, sf), scorecard.THRESHOLD))


@query("row_top_contrib")
def q_row_top(spark, sf):
    return tidy(explain.to_long(explain.row_top_contrib(explained(spark, sf)), col="top"))


@query("case_reasons")
def q_reasons(spark, sf):
    both = explain.case_reasons(explained(spark, sf))
    up, down = (explain.to_long(both, col=c).withColumn("side", F.lit(c)) for c in ("raising", "lowering"))
    return tidy(up.unionByName(down))


# --- decisions and reports -----------------------------------------------------------------


def decided(spark, sf) -> DataFrame:
    return pipeline.with_decision(card(spark, sf), scorecard.THRESHOLD)


@query("score_applications")
def q_score_applications(spark, sf):
    raw = borrowers(spark, sf)
    return tidy(pipeline.score_applications(raw, pipeline.stored_artifacts(spark, sf)).select(*DECISION_COLS))


@query("set_aside")
def q_set_aside(spark, sf):
    """Applications that get no score, and the fields that are missing or out of range."""
    aside = pipeline.set_aside(borrowers(spark, sf), pipeline.stored_artifacts(spark, sf))
    return aside.select(ID, F.array_join("violations", ",").alias("violations"))


@query("decide")
def q_decide(spark, sf):
    return decided(spark, sf).select(ID, "decision")


@query("risk_band")
def q_band(spark, sf):
    return tidy(decided(spark, sf).select(ID, "band", "risk_pct"))


@query("decision_margin")
def q_margin(spark, sf):
    return tidy(decided(spark, sf).select(ID, "margin_to_cut"))


@query("indicator_flags")
def q_flags(spark, sf):
    return policy.indicator_flags(borrowers(spark, sf)).select(ID, "late_flag", "dti_flag", "utilization_flag")


@query("policy_simulation")
def q_policy(spark, sf):
    best = metrics.best_threshold(metrics.threshold_sweep(card(spark, sf))).first()["threshold"]
    return tidy(policy.policy_simulation(card(spark, sf), best))


@query("reason_codes")
def q_reason_codes(spark, sf):
    return tidy(report.reason_codes(explained(spark, sf, None)))


@query("contribution_class")
def q_contribution_class(spark, sf):
    long = explain.to_long(explained(spark, sf, None))
    return long.select(ID, "feature", report.contribution_class(F.col("contribution")).alias("effect"))


@query("feature_dictionary")
def q_dictionary(spark, sf):
    return tidy(report.feature_dictionary(explain.importance_rank(explained(spark, sf, None), None)))


@query("format_indicator")
def q_format_indicator(spark, sf):
    long = explain.to_long(explained(spark, sf, None))
    return long.select(ID, "feature", display.format_indicator(F.col("feature"), F.col("value")).alias("shown"))


@query("indicator_table")
def q_indicator_table(spark, sf):
    return tidy(report.indicator_table(explained(spark, sf, None)))


@query("baseline_vs_final")
def q_baseline(spark, sf):
    means = explain.feature_means(pipeline.prepared(spark, sf, "train"), suffix=pipeline.SCALED)
    expected = scorecard.SCALED_INTERCEPT + sum(w * means[f] for f, w in scorecard.SCALED_WEIGHTS.items())
    cols = ["base_margin", "final_margin", "diff_margin", "base_prob", "final_prob", "diff_prob"]
    return tidy(explain.baseline_vs_final(explained(spark, sf, None), expected).select(ID, *cols), 4)


@query("decision_text")
def q_decision_text(spark, sf):
    return policy.decision_text(decided(spark, sf).select(ID, "decision"))


@query("stream_score")
def q_stream(spark, sf):
    raw = borrowers(spark, sf)
    landing, out = scratch_path(spark, "stream-in"), scratch_path(spark, "stream-out")
    raw.write.parquet(landing)
    running = stream_score(
        read_application_stream(spark, landing), pipeline.stored_artifacts(spark, sf), out, scratch_path(spark, "stream-log"),
        DECISION_COLS,
    )
    running.awaitTermination()
    return tidy(read_decisions(spark, out).select(*DECISION_COLS))


# --- rebalancing ---------------------------------------------------------------------------


def train_split(spark, sf) -> DataFrame:
    return pipeline.prepared(spark, sf, "train")


@query("smote")
def q_smote(spark, sf):
    made = rebalance.smote(train_split(spark, sf), FEATURE_COLS, pipeline.SCALED_COLS)
    return tidy(made.select(ID, LABEL, *FEATURE_COLS))


@query("tomek_links")
def q_tomek(spark, sf):
    return rebalance.tomek_links(train_split(spark, sf), pipeline.SCALED_COLS).select(ID, LABEL)


@query("smote_tomek")
def q_smote_tomek(spark, sf):
    made = rebalance.smote_tomek(train_split(spark, sf), FEATURE_COLS, pipeline.SCALED_COLS)
    return tidy(made.select(ID, LABEL, *FEATURE_COLS))


@query("class_counts_by_strategy")
def q_strategies(spark, sf):
    return tidy(rebalance.class_counts_by_strategy(rebalance.rebalanced(train_split(spark, sf), pipeline.SCALED_COLS)))


# --- models --------------------------------------------------------------------------------

# The registered models and the search run with the library's defaults.
_fitted: dict[tuple[str, str, str], str] = {}


def fitted(spark, sf, name: str):
    """A model trained on the training split, fitted and saved once per application."""
    def slot(n: str) -> tuple[str, str, str]:
        return spark.sparkContext.applicationId, sf, n

    if slot(name) not in _fitted:
        train, val = (pipeline.prepared(spark, sf, s) for s in ("train", "val"))
        cols = pipeline.SCALED_COLS
        if name == "logreg":
            made = {name: models.train_logreg(train, cols)}
        elif name == "gbt_balanced":
            made = {name: models.train_gbt_balanced(train, val, cols).model}
        else:
            boosted = models.train_gbt(train, val, cols)
            made = {"gbt": boosted.model, "gbt_full": boosted.full}
        for n, model in made.items():
            _fitted[slot(n)] = scratch_path(spark, f"model-{n}")
            io.save_model(model, _fitted[slot(n)])
    return io.load_model(_fitted[slot(name)])


def held_out(spark, sf) -> DataFrame:
    return pipeline.prepared(spark, sf).where("split in ('val', 'test')")


def model_scores(spark, sf, name: str) -> DataFrame:
    scored = models.score_model(fitted(spark, sf, name), held_out(spark, sf))
    return scored.select(ID, LABEL, "split", "margin", "prob")


@query("balanced_weights")
def q_balanced_weights(spark, sf):
    return tidy(models.balanced_weights(train_split(spark, sf).select(ID, LABEL)))


@query("scale_pos_weight")
def q_pos_weight(spark, sf):
    return models.scale_pos_weight(train_split(spark, sf).select(ID, LABEL), 3.0)


@query("train_logreg")
def q_logreg(spark, sf):
    return model_scores(spark, sf, "logreg")


@query("train_gbt")
def q_gbt(spark, sf):
    return model_scores(spark, sf, "gbt")


@query("train_gbt_balanced")
def q_gbt_balanced(spark, sf):
    return model_scores(spark, sf, "gbt_balanced")


@query("save_model")
def q_save_model(spark, sf):
    """Held-out rows, and how many of them score the same after the model was saved and reloaded."""
    model = models.train_logreg(train_split(spark, sf), pipeline.SCALED_COLS)
    path = scratch_path(spark, "saved-model")
    io.save_model(model, path)
    before = models.score_model(model, held_out(spark, sf)).select(ID, F.col("prob").alias("before"))
    after = models.score_model(io.load_model(path), held_out(spark, sf)).select(ID, F.col("prob").alias("after"))
    return before.join(after, ID).agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("before") == F.col("after")).alias("n_equal")
    )


@query("model_comparison_fitted")
def q_fitted_comparison(spark, sf):
    scored = None
    for name in ("logreg", "gbt", "gbt_balanced"):
        part = model_scores(spark, sf, name).withColumn("model", F.lit(name))
        scored = part if scored is None else scored.unionByName(part)
    return metrics.model_comparison(materialize(scored, "model-scores"), score="margin")


@query("hyperparam_search")
def q_search(spark, sf):
    table, _ = models.hyperparam_search(
        train_split(spark, sf), pipeline.prepared(spark, sf, "val"), pipeline.SCALED_COLS
    )
    return table


@query("learning_curve")
def q_learning_curve(spark, sf):
    rows = pipeline.prepared(spark, sf).where("split in ('train', 'val')")
    return models.learning_curve(fitted(spark, sf, "gbt_full"), rows, pipeline.SCALED_COLS)


@query("explain_trees")
def q_explain_trees(spark, sf):
    found = trees.load_trees(fitted(spark, sf, "gbt"), spark)
    test = pipeline.prepared(spark, sf, "test")
    return explain.to_long(trees.explain_trees(test, found, pipeline.SCALED_COLS, shown=FEATURE_COLS))


@query("expected_value")
def q_expected_value(spark, sf):
    found = trees.load_trees(fitted(spark, sf, "gbt"), spark)
    return trees.expected_value(pipeline.prepared(spark, sf, "test"), found)


@query("explain_trees_additivity")
def q_additivity(spark, sf):
    """Test rows, and how many have contributions that sum, with the expected value, to their margin."""
    model = fitted(spark, sf, "gbt")
    found = trees.load_trees(model, spark)
    test = pipeline.prepared(spark, sf, "test")
    rows = trees.explain_trees(models.score_model(model, test), found, pipeline.SCALED_COLS, keep=[ID, "margin"])
    gap = trees.total_contribution() + F.lit(trees.expected_margin(found)) - F.col("margin")
    return rows.agg(F.count("*").alias("n_rows"), F.count_if(F.abs(gap) < 1e-9).alias("n_additive"))


# --- the frozen forest: tree operators with SQL beside them ------------------------------------


@query("forest_score")
def q_forest_score(spark, sf):
    """Held-out rows scored by the forest as a relation of leaf boxes."""
    rows, found = held_out(spark, sf), forest.frozen_forest()
    margins = trees.box_margins(rows, trees.box_table(found, pipeline.SCALED_COLS, spark), pipeline.SCALED_COLS)
    return tidy(margins.withColumn("prob", scorecard.logistic(F.col("margin"))))


@query("forest_learning_curve")
def q_forest_curve(spark, sf):
    rows = pipeline.prepared(spark, sf).where("split in ('train', 'val')")
    return tidy(models.learning_curve(forest.frozen_forest(), rows, pipeline.SCALED_COLS))


@query("forest_explain")
def q_forest_explain(spark, sf):
    test = pipeline.prepared(spark, sf, "test")
    return tidy(explain.to_long(trees.explain_trees(test, forest.frozen_forest(), pipeline.SCALED_COLS, shown=FEATURE_COLS)))


@query("forest_expected_value")
def q_forest_expected(spark, sf):
    return tidy(trees.expected_value(pipeline.prepared(spark, sf, "test"), forest.frozen_forest()))


@query("logreg_certificate")
def q_certificate(spark, sf):
    """The logistic objective's gradient and curvature at the scaled card's coefficients."""
    return tidy(models.logreg_certificate(
        train_split(spark, sf), scorecard.SCALED_WEIGHTS, scorecard.SCALED_INTERCEPT, suffix=pipeline.SCALED
    ))
