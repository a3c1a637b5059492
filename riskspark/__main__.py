"""Command line for the phases: python -m riskspark {profile,prepare,train,score} ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from riskspark.plans import workflow
from riskspark.session import SCRATCH
from riskspark.sources.applications import malformed_applications, read_applications_csv


def main() -> None:
    parser = argparse.ArgumentParser(prog="riskspark")
    phases = parser.add_subparsers(dest="phase", required=True)
    for name in ("profile", "prepare", "train", "score"):
        phase = phases.add_parser(name)
        phase.add_argument("--out", required=True, help="folder of the stored artifacts")
        if name != "train":
            phase.add_argument("--csv", required=True, help="applications as a headed CSV")
    phases.choices["train"].add_argument("--trials", type=int, default=50)
    phases.choices["score"].add_argument("--to", required=True, help="folder for decisions, set-aside rows and reports")
    phases.choices["score"].add_argument("--threshold", type=float)
    args = parser.parse_args()

    spark = SparkSession.builder.appName(f"riskspark-{args.phase}").getOrCreate()
    spark.conf.set(SCRATCH, f"{args.out}/scratch")
    if args.phase == "train":
        workflow.run_train(spark, args.out, args.trials).show()
        return
    applications = read_applications_csv(spark, args.csv)
    if args.phase == "profile":
        workflow.run_profile(applications, args.out)
    elif args.phase == "prepare":
        workflow.run_prepare(applications, args.out)
    else:
        workflow.run_score(applications, args.out, args.to, args.threshold)
        malformed_applications(spark, args.csv).write.mode("overwrite").parquet(f"{args.to}/malformed")


if __name__ == "__main__":
    main()
