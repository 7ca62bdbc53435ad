"""Command line: `python -m riskloom.cli extract|score|retrain ...`."""

from __future__ import annotations

import argparse
import sys

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from riskloom.functions.columns import notable_factors, risk_level
from riskloom.operators import history, models
from riskloom.plans import retrain
from riskloom.schemas import MODEL_VERSION
from riskloom.sources import gitlog, readers, sinks


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="riskloom")
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("extract", "score", "retrain"):
        p = sub.add_parser(name)
        p.add_argument("--repo-path", action="append", required=True, help="working copy or URL; may be given more than once")
        p.add_argument("--cache", default="repositories")
        p.add_argument("--since", default=None)
        p.add_argument("--config", default=None)
    sub.choices["extract"].add_argument("--output", required=True)
    sub.choices["extract"].add_argument("--max-commits", type=int, default=0)
    sub.choices["score"].add_argument("--commit-hash", required=True)
    sub.choices["score"].add_argument("--model-path", required=True)
    sub.choices["retrain"].add_argument("--registry", required=True)
    sub.choices["retrain"].add_argument("--model-path", required=True)
    sub.choices["retrain"].add_argument("--min-rows", type=int, default=100)
    return top


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    own = parser().parse_args(args)
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    settings = readers.config(own.config, {"label_window_days": 7})
    commits = None
    for source in own.repo_path:
        part = gitlog.commits(spark, gitlog.open_repository(source, own.cache), **({"since": own.since} if own.since else {}))
        commits = part if commits is None else commits.unionByName(part)
    days = int(settings["label_window_days"])
    if own.command == "extract":
        if own.max_commits:
            commits = commits.orderBy("source_repo", "seq").limit(own.max_commits)
        sinks.csv(retrain.ingest(commits, days), own.output)
    elif own.command == "score":
        row = models.scored(PipelineModel.load(own.model_path), history.single_commit(commits, own.commit_hash))
        shown = row.select(sinks.report_text(F.col("hash"), F.col("risk_score"), risk_level(F.col("risk_score")), notable_factors(), F.col("author")).alias("r"), sinks.gate_lines(F.col("risk_score"), F.col("risk_label")).alias("g")).first()
        print(shown["r"], shown["g"], sep="\n\n")
    else:
        versions = readers.cached(spark, own.registry, MODEL_VERSION, lambda: spark.createDataFrame([], MODEL_VERSION))
        results, after, model = retrain.retrain(commits, versions, days, own.min_rows)
        rows = after.collect()  # a registry has a row per version
        model.write().overwrite().save(own.model_path)
        sinks.csv(spark.createDataFrame(rows, MODEL_VERSION).coalesce(1), own.registry)
        results.show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
