"""Classifiers: fitting, comparing, scoring, importance, export and reload, all with Spark ML.

Defined results: null features count as 0, as a missing feature does when a
request is scored; rows without a label are not fitted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.columns import risk_level
from riskloom.operators.metrics import classification
from riskloom.schemas import FEATURES


def filled(df: DataFrame, columns: Sequence[str] = FEATURES) -> DataFrame:
    """The feature columns as doubles, nulls as 0."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns})


def pipeline(kind: str, label: str = "risky", columns: Sequence[str] = FEATURES) -> Pipeline:
    """boosted, forest, logistic or network, over the ordered feature vector."""
    common = {"labelCol": label, "featuresCol": "vector"}
    scale = StandardScaler(inputCol="raw_vector", outputCol="vector", withMean=True)
    stage = {
        "boosted": lambda: GBTClassifier(maxIter=20, maxDepth=5, stepSize=0.1, seed=42, **common),
        "forest": lambda: RandomForestClassifier(numTrees=100, maxDepth=10, seed=42, **common),
        "logistic": lambda: LogisticRegression(maxIter=1000, regParam=1e-4, **common),
        "network": lambda: MultilayerPerceptronClassifier(layers=[len(columns), 64, 32, 2], maxIter=40, seed=42, **common),
    }[kind]()
    return Pipeline(stages=[VectorAssembler(inputCols=list(columns), outputCol="raw_vector"), scale, stage])


def fit(df: DataFrame, kind: str, label: str = "risky", columns: Sequence[str] = FEATURES) -> PipelineModel:
    known = filled(df.filter(F.col(label).isNotNull()), columns).withColumn(label, F.col(label).cast("double"))
    return pipeline(kind, label, columns).fit(known.select(*columns, label))


def scored(model: PipelineModel, df: DataFrame, columns: Sequence[str] = FEATURES) -> DataFrame:
    """`df` with risk_score, predicted and risk_label."""
    used = {c: f"__own_{c}" for c in columns if c in df.columns}
    kept = df.withColumns({v: F.col(k) for k, v in used.items()})
    done = model.transform(filled(kept, columns)).withColumn("risk_score", vector_to_array("probability")[1])
    back = [F.col(used.get(c, c)).alias(c) for c in df.columns]
    return done.select(*back, "risk_score", (F.col("risk_score") >= 0.5).cast("int").alias("predicted"), risk_level(F.col("risk_score")).alias("risk_label"))


def compare(train: DataFrame, test: DataFrame, kinds: Sequence[str], label: str = "risky") -> DataFrame:
    """(ord, name, n, accuracy, precision, recall, f1) of each kind on the test part. The kinds are few and listed."""
    out = None
    for i, kind in enumerate(kinds):
        row = classification(scored(fit(train, kind, label), test), label, "predicted").select(F.lit(i).alias("ord"), F.lit(kind).alias("name"), "n", "accuracy", "precision", "recall", "f1")
        out = row if out is None else out.unionByName(row)
    return out


def importance(spark, model: PipelineModel, columns: Sequence[str] = FEATURES) -> DataFrame:
    """(feature, importance), highest first."""
    last = model.stages[-1]
    values = last.featureImportances.toArray() if hasattr(last, "featureImportances") else [abs(float(x)) for x in last.coefficients.toArray()]
    return spark.createDataFrame([(c, float(v)) for c, v in zip(columns, values)], "feature string, importance double").orderBy(F.desc("importance"), "feature")


def export(model: PipelineModel, path: str) -> PipelineModel:
    """Saves, loads again and checks that the last stage is of the same type."""
    model.write().overwrite().save(path)
    again = PipelineModel.load(path)
    if type(again.stages[-1]) is not type(model.stages[-1]):
        raise ValueError(f"{path} holds another type of model")
    return again
