"""Every registered query against its SQL counterpart, and the shape of the plans."""

import functools
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from riskspark.plans import pipeline, registry, workflow
from riskspark.operators import metrics, models
from riskspark.plans import scorecard
from riskspark.sources import artifacts as stored
from riskspark.sources.borrowers import borrowers
from riskspark.streaming.score_stream import read_application_stream, read_decisions, read_set_aside, stream_score, write_batch

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))
from check_oracle import TABLES, canonical  # noqa: E402

ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query_equals_sql(spark, sf, duck, key):
    df = entry.queries()[key](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    cur = duck.execute(ORACLE[key])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert canonical(rows, df.columns) == canonical(cur.fetchall(), cols)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_oracle_names_are_queries():
    assert set(ORACLE) <= set(entry.queries())


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_features_are_one_scan_without_python(spark, sf):
    raw = borrowers(spark, sf)
    text = plan(pipeline.featured(raw, pipeline.fit_medians(raw)))
    assert "PushedFilters: [IsNotNull(age), GreaterThan(age,0), LessThanOrEqual(age,95)]" in text
    assert "Python" not in text and "Exchange hashpartitioning" not in text and "BroadcastHashJoin" in text


def test_metrics_never_sort_everything_in_one_place(spark, sf):
    curve = plan(metrics.roc_curve(scorecard.card_a(borrowers(spark, sf))))
    assert "CartesianProduct" not in curve and "rangepartitioning" not in curve
    # What reaches a single partition is bucket totals or an aggregate without keys.
    for part in curve.split("Exchange SinglePartition")[1:]:
        below = part.split("FileScan")[0]
        assert "_bucket" in below or "HashAggregate(keys=[]" in below


def test_batch_and_stream_agree_with_a_fitted_model(spark, sf, tmp_path):
    raw = borrowers(spark, sf)
    out = str(tmp_path / "artifacts")
    workflow.run_prepare(raw, out)
    space = {**models.SEARCH_SPACE, "rounds": (3, 4, False), "max_depth": (2, 3, False)}
    compared = workflow.run_train(spark, out, n_trials=1, space=space, balanced_rounds=3)
    assert compared.count() == 6
    artifacts, model = workflow.load_artifacts(spark, out)
    assert 0.1 <= artifacts.threshold <= 0.9
    batch = workflow.score_with_model(raw, artifacts, model)
    assert batch.where("text is null or label is null").count() == 0
    explained = workflow.explain_with_model(raw, artifacts, model)
    reports = workflow.explanation_reports(explained, artifacts.threshold)
    assert reports["cases"].count() == 3 and reports["importance"].count() == 10

    workflow.run_score(raw, out, str(tmp_path / "scored"))
    written = {p.name: spark.read.parquet(str(p)).count() for p in (tmp_path / "scored" / "reports").iterdir()}
    n = spark.read.parquet(str(tmp_path / "scored" / "decisions")).count()
    assert n + spark.read.parquet(str(tmp_path / "scored" / "set_aside")).count() == raw.count()
    assert written["reasons"] == 10 * n and written["indicators"] == 19 * n and written["baseline"] == n and written["cases"] == 3

    # A second preparation doesn't touch what the model was trained on; both are versions.
    workflow.run_prepare(raw.where("id % 3 <> 0"), out)
    again, _ = workflow.load_artifacts(spark, out)
    assert again.scale == artifacts.scale and again.threshold == artifacts.threshold
    assert [v.number for v in stored.versions(spark, out, workflow.PREPARE)] == [1, 2]

    cols = registry.DECISION_COLS
    raw.write.parquet(str(tmp_path / "in"))
    fitted = pipeline.Artifacts(artifacts.medians, artifacts.scale, artifacts.threshold)
    query = stream_score(
        read_application_stream(spark, str(tmp_path / "in")), fitted, str(tmp_path / "decisions"),
        str(tmp_path / "log"), cols,
    )
    query.awaitTermination()
    streamed = {tuple(r) for r in read_decisions(spark, str(tmp_path / "decisions")).collect()}
    assert streamed == {tuple(r) for r in pipeline.score_applications(raw, fitted).select(*cols).collect()}

    # A fitted model meets rows with missing features: they are set aside, in a batch and in the stream alike.
    holes = raw.withColumns({
        "debt_ratio": F.when(F.col("id") % 5 != 0, F.col("debt_ratio")), "late_90d": F.when(F.col("id") % 7 != 0, F.col("late_90d")),
        "age": F.when(F.col("id") % 11 != 0, F.col("age")), "revolving_utilization": F.when(F.col("id") % 13 == 0, float("nan")).otherwise(F.col("revolving_utilization")),
    }).persist()
    holes.repartition(3).write.parquet(str(tmp_path / "holes"))
    score = functools.partial(models.score_model, model)
    query = stream_score(
        read_application_stream(spark, str(tmp_path / "holes")), artifacts, str(tmp_path / "served"), str(tmp_path / "log2"), cols, score
    )
    query.awaitTermination()
    assert query.exception() is None
    decided = {tuple(r) for r in pipeline.score_applications(holes, artifacts, score).select(*cols).collect()}
    aside = {r["id"]: r["violations"] for r in pipeline.set_aside(holes, artifacts).collect()}
    assert len(decided) + len(aside) == raw.count() and decided
    assert {tuple(r) for r in read_decisions(spark, str(tmp_path / "served")).collect()} == decided
    assert {r["id"]: r["violations"] for r in read_set_aside(spark, str(tmp_path / "served")).collect()} == aside
    for i, names in aside.items():
        assert names == ["age"] or set(names) & {"debt_ratio", "late_90d", "revolving_utilization"}
        assert ("debt_ratio" in names) == (i % 5 == 0) or names == ["age"]
    # The same batch again replaces its folders.
    write_batch(holes, 0, artifacts, str(tmp_path / "served"), cols, score)
    write_batch(holes, 0, artifacts, str(tmp_path / "served"), cols, score)
    assert read_decisions(spark, str(tmp_path / "served")).count() == len(decided)
    holes.unpersist()


def test_profile_phase_writes_every_report(spark, sf, tmp_path):
    raw = borrowers(spark, sf)
    workflow.run_profile(raw, str(tmp_path))
    assert len(list((tmp_path / "profile").iterdir())) == len(workflow.profile_reports(raw))


def test_splits_prune_by_folder(spark, sf):
    text = plan(pipeline.prepared(spark, sf, "test"))
    assert "PartitionFilters: [isnotnull(split" in text


def test_serving_equals_training_features(spark, sf):
    raw = borrowers(spark, sf)
    artifacts = pipeline.fit_artifacts(raw)
    served = pipeline.score_applications(raw, artifacts).select("id", *pipeline.SCALED_COLS)
    trained = pipeline.prepared(spark, sf).select("id", *pipeline.SCALED_COLS)
    assert served.exceptAll(trained).count() == 0 and trained.exceptAll(served).count() == 0
