"""The model registry as a table: choosing, promoting and joining versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators.metrics import best_by
from riskloom.session import scalars


def numbered(versions: DataFrame) -> DataFrame:
    return versions.withColumn("number", F.expr("try_cast(version as int)"))


def production(versions: DataFrame) -> DataFrame:
    """The Production version with the greatest number; no row if there is none."""
    return numbered(versions).filter(F.col("stage") == "Production").agg(F.max_by(F.struct(*versions.columns), "number").alias("r")).filter("r is not null").select("r.*")


def latest(versions: DataFrame) -> DataFrame:
    """The version with the greatest number, of any stage."""
    return numbered(versions).agg(F.max_by(F.struct(*versions.columns), "number").alias("r")).filter("r is not null").select("r.*")


def decide(versions: DataFrame, candidate: str) -> DataFrame:
    """(version, candidate_f1, current_f1, promote): promoted if nothing is in Production or the score is strictly higher; a missing score is 0."""
    new = versions.filter(F.col("version") == candidate).select("version", F.coalesce("f1", F.lit(0.0)).alias("candidate_f1"))
    now = scalars(production(versions), k=F.count(F.lit(1)), f1=F.max(F.coalesce("f1", F.lit(0.0))))
    return new.select("version", "candidate_f1", now["f1"].alias("current_f1"), ((now["k"] == 0) | (F.col("candidate_f1") > now["f1"])).alias("promote"))


def promoted(versions: DataFrame, candidate: str) -> DataFrame:
    """The registry after the decision: the candidate in Production and former Production versions archived, or unchanged."""
    promote = F.coalesce(scalars(decide(versions, candidate), p=F.bool_or("promote"))["p"], F.lit(False))
    stage = F.when(promote & (F.col("version") == candidate), "Production").when(promote & (F.col("stage") == "Production"), "Archived").otherwise(F.col("stage"))
    return versions.withColumn("stage", stage)


def with_metrics(versions: DataFrame, runs: DataFrame) -> DataFrame:
    """Versions with the metrics of their run."""
    own = runs.withColumnRenamed("run_id", "__run")
    return versions.join(own, versions["run_id"] == own["__run"], "left").drop("__run")


def best_candidate(results: DataFrame) -> DataFrame:
    """The candidate with the highest f1, the first in order among equals."""
    return best_by(results, "f1", "ord")
