"""Scoring of an application stream with the batch plan, and what can't be scored set aside."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from riskspark.plans.pipeline import Artifacts, score_applications, score_scaled_card, set_aside
from riskspark.schema import BORROWER_SCHEMA

DECISIONS, ASIDE, BATCH = "decisions", "set_aside", "batch"


def read_application_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(BORROWER_SCHEMA).parquet(path)


def write_batch(
    applications: DataFrame, batch: int, artifacts: Artifacts, out: str, columns: list[str],
    score: Callable[[DataFrame], DataFrame] = score_scaled_card,
) -> None:
    """Decisions and set-aside rows of one batch, each in the batch's own folder.

    A batch that comes again after a failure replaces its folders, so both outputs hold every row once.
    """
    applications.persist()
    try:
        scored = score_applications(applications, artifacts, score).select(*columns)
        for name, rows in ((DECISIONS, scored), (ASIDE, set_aside(applications, artifacts))):
            rows.write.mode("overwrite").parquet(f"{out}/{name}/{BATCH}={batch}")
    finally:
        applications.unpersist()


def stream_score(
    applications: DataFrame, artifacts: Artifacts, out: str, checkpoint: str, columns: list[str],
    score: Callable[[DataFrame], DataFrame] = score_scaled_card,
) -> StreamingQuery:
    """Score what has arrived: decisions below `out`/decisions, rows that can't be scored, with their violations,
    below `out`/set_aside. Stateless, exactly once through the checkpoint and the batch's folder."""
    return (
        applications.writeStream.foreachBatch(lambda rows, batch: write_batch(rows, batch, artifacts, out, columns, score))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def read_decisions(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/{DECISIONS}").drop(BATCH)


def read_set_aside(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/{ASIDE}").drop(BATCH)
