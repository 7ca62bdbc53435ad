"""The whole run, from commits to a registry decision, and scoring of single requests.

Stages are lazy; the labelled features are written once, before checks and
models read them. Ingest, check, compare and register are separate functions too.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.columns import contains_any
from riskloom.operators import history, models, quality, registry, sampling
from riskloom.operators.metrics import best_by
from riskloom.schemas import FEATURES, REQUEST
from riskloom.session import materialise

KINDS = ("boosted", "forest", "logistic")


def ingest(commits: DataFrame, days: int = 7, words: Sequence[str] = ("revert",)) -> DataFrame:
    """Labelled feature rows of nested commits (`schemas.COMMIT`), in all repositories at once."""
    rows = history.features_of_commits(commits)
    touches = history.explode_touches(commits).withColumn("touch_id", F.xxhash64("hash", "ord"))
    hit = history.retouched(touches, days).withColumnRenamed("hash", "__hash")
    joined = rows.join(hit, rows["hash"] == hit["__hash"], "left")
    return joined.withColumn("risky", (F.col("__hash").isNotNull() | contains_any(F.col("commit_msg"), words)).cast("int")).drop("__hash", "commit_msg")


def checked(rows: DataFrame, min_rows: int = 100, min_positive: float = 0.05) -> DataFrame:
    """The rows, if no check of severity `error` fails; else ValueError with the failed checks."""
    failed = [r.check_name for r in quality.table_checks(rows, [*FEATURES, "risky", "hash"], "risky", min_rows, min_positive).filter("severity = 'error' and not passed").collect()]
    if failed:  # at most four rows
        raise ValueError(f"failed checks: {failed}")
    return rows


def retrain(commits: DataFrame, versions: DataFrame, days: int = 7, min_rows: int = 100, min_positive: float = 0.05, kinds: Sequence[str] = KINDS) -> tuple[DataFrame, DataFrame, PipelineModel]:
    """(comparison, registry after the decision, the best model)."""
    rows = checked(materialise(ingest(commits, days), "features"), min_rows, min_positive)
    parted = materialise(sampling.stratified_split(rows, "hash", "risky"), "split")
    train, test = parted.filter("is_test = 0"), parted.filter("is_test = 1")
    results = materialise(models.compare(train, test, kinds), "results")
    best = best_by(results, "f1", "ord").first()
    spark = commits.sparkSession
    number = str((registry.numbered(versions).agg(F.max("number")).first()[0] or 0) + 1)
    new = spark.createDataFrame([(number, uuid.uuid4().hex, "None", best["f1"])], versions.schema)
    return results, registry.promoted(versions.unionByName(new), number), models.fit(train, best["name"])


def predict(spark: SparkSession, model: PipelineModel | None, features: dict, commit_hash: str | None = None) -> dict:
    """The response to one request: risk_score, risk_label and the hash. ValueError for missing or wrong features, RuntimeError without a model."""
    if model is None:
        raise RuntimeError("no model is loaded")
    values = [features.get(c) if isinstance(features, dict) else None for c in FEATURES]
    if any(isinstance(v, bool) or not isinstance(v, int) for v in values):
        raise ValueError(f"features have to be integers: {[c for c, v in zip(FEATURES, values) if isinstance(v, bool) or not isinstance(v, int)]}")
    row = quality.request_violations(spark.createDataFrame([tuple(values)], REQUEST))
    if wrong := row.first()["violations"]:
        raise ValueError(f"out of range: {list(wrong)}")
    got = models.scored(model, row.drop("violations")).first()
    return {"risk_score": float(got["risk_score"]), "risk_label": got["risk_label"], "commit_hash": commit_hash or features.get("hash") or ""}
