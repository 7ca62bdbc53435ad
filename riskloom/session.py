"""Session helpers: reading tables and cutting lineage in the folder all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable in Python workers, once per application, unless PYTHONPATH already does."""
    root = Path(__file__).resolve().parent.parent
    app = spark.sparkContext.applicationId
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or app in _SHIPPED:
        return
    at = Path(tempfile.mkdtemp(prefix="riskloom-package-")) / "riskloom.zip"  # on the driver only; Spark serves it to the executors
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted((root / "riskloom").rglob("*.py")):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(str(at))
    _SHIPPED.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data folder; column pruning and filters reach this scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scalars(df: DataFrame, **aggregates: Column) -> Column:
    """Aggregates of a whole table as a struct column for use in other tables: a scalar subquery, not a join."""
    return df.agg(F.struct(*[c.alias(n) for n, c in aggregates.items()]).alias("s")).scalar()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder (`spark.checkpoint.dir`). Only a local session may fall back to a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = os.environ.get("RISKLOOM_LOCAL_CHECKPOINTS")
    if not own:
        own = os.environ["RISKLOOM_LOCAL_CHECKPOINTS"] = tempfile.mkdtemp(prefix="riskloom-")
    return own


def spread(df: DataFrame, key: str) -> DataFrame:
    """`df` over all cores, for steps that take longer than moving their rows.

    Only an input of fewer partitions than cores, such as a single small file, is
    moved; by a hash of a key, so that a task run again gets the same rows.
    """
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    if any(x in plan for x in ("Aggregate", "Join", "Window", "Sort", "Repartition", "Limit")):
        return df  # its partitions come from a shuffle; counting them would run it
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """Writes `df` as Parquet into the shared folder and reads it back.

    This cuts the lineage, so a lost executor costs no earlier step, and fixes
    what a second use of the same rows sees. The table stays until the folder
    is emptied; it is compressed and smaller than a checkpoint of the rows.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark).rstrip('/')}/riskloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)
