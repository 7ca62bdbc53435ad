"""Request metrics over time: rates in sliding windows, sums by label, anchored label filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matching(df: DataFrame, label: str, pattern: str) -> DataFrame:
    """Rows whose label matches the whole pattern."""
    return df.filter(F.col(label).rlike(f"^(?:{pattern})$"))


def sliding_rate(df: DataFrame, moment: str, seconds: int, step: int, groups: tuple[str, ...] = ()) -> DataFrame:
    """(groups, window_start, events, per_second) of each window with events. Partial counts leave each task per step."""
    steps = df.groupBy(*groups, F.window(F.col(moment).cast("timestamp"), f"{step} seconds")["start"].alias("s")).agg(F.count(F.lit(1)).alias("k"))
    wins = steps.groupBy(*groups, F.window("s", f"{seconds} seconds", f"{step} seconds")["start"].alias("w")).agg(F.sum("k").alias("events"))
    return wins.select(*groups, F.col("w").cast("timestamp_ntz").alias("window_start"), "events", (F.col("events") / seconds).alias("per_second"))


def sum_by(df: DataFrame, label: str, value: str) -> DataFrame:
    return df.groupBy(label).agg(F.sum(value).alias("total"))
