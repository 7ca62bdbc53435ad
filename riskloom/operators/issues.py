"""Issue analytics: filtered pages, totals, pivots, inserts and updates."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.columns import violations
from riskloom.operators.metrics import daily_pivot, pivot_counts

STATUSES = ["open", "resolved"]


def filtered(issues: DataFrame, status: str | None = None, repo: str | None = None) -> DataFrame:
    """Rows that match the filters given; an empty filter is none."""
    for name, value in (("status", status), ("repo", repo)):
        if value:
            issues = issues.filter(F.col(name) == value)
    return issues


def page(issues: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """Newest first, equal times by id downwards. Spark keeps only the top rows of each task."""
    return issues.orderBy(F.col("created_at").desc_nulls_last(), F.col("id").desc()).offset(offset).limit(limit)


def since(issues: DataFrame, now: datetime, days: int) -> DataFrame:
    """Rows of the last days before `now`. The bound is a literal, so it reaches the scan."""
    return issues.filter(F.col("created_at") >= F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {days} days"))


def daily_counts(issues: DataFrame, now: datetime, days: int) -> DataFrame:
    """Per day with rows in the window: open and resolved; other states are not counted."""
    return daily_pivot(since(issues, now, days), "created_at", "status", STATUSES)


def totals(issues: DataFrame) -> DataFrame:
    """(open, resolved, total) over all time; total is their sum."""
    return issues.agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES]).withColumn("total", F.col("open") + F.col("resolved"))


def by_type(issues: DataFrame) -> DataFrame:
    return pivot_counts(issues, F.col("type"), "type", "status", STATUSES)


def by_gate(issues: DataFrame) -> DataFrame:
    return pivot_counts(issues, F.concat(F.lit("gate_"), F.col("gate").cast("string")), "gate", "status", STATUSES)


def checked(issues: DataFrame) -> DataFrame:
    """Adds `violations`: what keeps a row from being inserted."""
    rules = {"gate": F.col("gate").isin(1, 2, 3), "type": F.length("type").between(1, 50), "repo": F.length("repo").between(1, 255), "status": F.length("status") <= 20, "commit_hash": F.col("commit_hash").isNull() | (F.length("commit_hash") <= 40)}
    return issues.withColumn("violations", violations(rules))


def insert(issues: DataFrame, new: DataFrame) -> DataFrame:
    """The table with the valid new rows; append with `new_rows(...).write.mode("append")` where it is stored."""
    return issues.unionByName(new_rows(new).select(issues.columns))


def new_rows(new: DataFrame) -> DataFrame:
    return checked(new).filter(F.size("violations") == 0).drop("violations")


def toggled(issues: DataFrame, issue_id: int, now: datetime) -> DataFrame:
    """The table after one issue has changed between open and resolved (any other state becomes open)."""
    hit = F.col("id") == issue_id
    status = F.when(hit, F.when(F.col("status") == "open", "resolved").otherwise("open")).otherwise(F.col("status"))
    return issues.withColumns({"status": status, "updated_at": F.when(hit, F.lit(now).cast("timestamp_ntz")).otherwise(F.col("updated_at"))})


def as_json(issues: DataFrame) -> DataFrame:
    """(id, json): rows as JSON with ISO times; null fields are kept."""
    times = {c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") for c in ("created_at", "updated_at")}
    return issues.withColumns(times).select("id", F.to_json(F.struct(*issues.columns), {"ignoreNullFields": "false"}).alias("json"))
