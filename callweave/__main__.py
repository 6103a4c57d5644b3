"""``spark-submit -m callweave``-style entry: ``python -m callweave summarise|topics ...``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from callweave.plans.jobs import run_summarise_job, run_topic_job
from callweave.scorers.builtin import LexicalClassifier
from callweave.session import ship_package
from callweave.sources.catalogue import Catalogue, read_catalogue


def main() -> None:
    parser = argparse.ArgumentParser(prog="callweave")
    jobs = parser.add_subparsers(dest="job", required=True)
    for name, source in (("summarise", "parquet folder of calls"), ("topics", "folder the summarise job wrote")):
        job = jobs.add_parser(name)
        job.add_argument("source", help=source)
        job.add_argument("out", help="parquet folder, partitioned by run date")
        job.add_argument("--run-date", required=True, help="e.g. 2026_01_31")
        if name == "topics":
            job.add_argument("--catalogue", required=True, help="JSON file of topic names and descriptions")
    args = parser.parse_args()

    spark = SparkSession.builder.appName(f"callweave {args.job}").getOrCreate()
    ship_package(spark)
    if args.job == "summarise":
        report = run_summarise_job(spark, args.source, args.out, args.run_date)
    else:
        topics = Catalogue(read_catalogue(spark, args.catalogue))
        report = run_topic_job(spark, args.source, topics, args.out, args.run_date, LexicalClassifier())
    print(report)


if __name__ == "__main__":
    main()
