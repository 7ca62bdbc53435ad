"""Structured Streaming twins of batch results: sliding rates, issue counts, incremental labels.

Sources are Parquet folders; event times become TIMESTAMP for watermarks. Results
are written per batch into tables of the shared folder, never into driver memory.
A run with `availableNow` processes what is there and ends; in append mode
windows above the watermark stay open, so comparisons with batch results use
complete mode or closed windows.
"""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.history import retouched, with_path
from riskloom.session import materialise, scalars, shared_dir, table


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet")


def run_once(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over what is there. complete: the last result; append: all rows written. Batches are numbered, so a repeated one replaces itself."""
    spark = stream.sparkSession
    at = f"{shared_dir(spark).rstrip('/')}/riskloom-stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/table" if mode == "complete" else f"{at}/table/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/table") if mode == "complete" else spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{at}/table")


def sliding_counts(events: DataFrame, moment: str, late: str, length: str, step: str, label: str) -> DataFrame:
    """Events per label and sliding window, with a watermark for late ones."""
    timed = events.withColumn("__t", F.col(moment).cast("timestamp")).withWatermark("__t", late)
    return timed.groupBy(F.window("__t", length, step)["start"].alias("window_start"), label).agg(F.count(F.lit(1)).alias("events"))


def status_counts(issues: DataFrame) -> DataFrame:
    """Running counts of issues per type and status."""
    return issues.groupBy("type", "status").agg(F.count(F.lit(1)).alias("issues"))


def retouched_once(touches: DataFrame, days: int = 7, late: int = 90) -> DataFrame:
    """(hash), each once a batch: runs a stream of touches over what is there; commits whose path is touched again within `days`.

    Touches of a path arrive in date order, or within one batch. What is kept between
    batches is a table: the last touch of each path, as far as it is not older than
    `days` and `late` more days before the newest. A batch joins it and is
    labelled by the batch operator, in slices of time, so a path that holds much of the
    table is in many tasks. Batches are numbered: one that is run again reads the
    table that it read before, and replaces its own results.
    """
    spark = touches.sparkSession
    at = f"{shared_dir(spark).rstrip('/')}/riskloom-stream-{uuid.uuid4().hex}"
    columns = ["source_repo", "path", "hash", "date", "seq", "ord", "touch_id"]

    def write(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        own = with_path(batch).select(*columns).filter("date is not null")
        if number:
            own = own.unionByName(session.read.schema(own.schema).parquet(f"{at}/state/batch={number - 1}"))
        own = materialise(own, "touches")
        hits = retouched(own.withColumns({"new_path": F.col("path"), "old_path": F.lit(None).cast("string")}), days)
        hits.write.mode("overwrite").parquet(f"{at}/table/batch={number}")
        last = own.groupBy("source_repo", "path").agg(F.max(F.struct("date", "seq", "ord", "touch_id", "hash")).alias("t")).select("source_repo", "path", "t.*").select(*columns)
        newest = scalars(own, d=F.max("date"))["d"]
        last.filter(F.col("date") >= newest - F.expr(f"interval {days + 1 + late} days")).write.mode("overwrite").parquet(f"{at}/state/batch={number}")

    query = touches.writeStream.foreachBatch(write).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("hash string").option("recursiveFileLookup", "true").parquet(f"{at}/table")


def scored_stream(requests: DataFrame, model) -> DataFrame:
    """Scores of a stream of requests; fitted pipelines transform streams as tables."""
    from riskloom.operators.models import scored

    return scored(model, requests)


def now_fixed() -> datetime:
    """The moment that relative windows of the queries end at, so that results can be made again."""
    return datetime(2024, 5, 1)
