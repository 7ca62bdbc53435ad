"""Writers and rendered reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.columns import lookup
from riskloom.operators.skew import quantile_slices, sliced_running

# How levels are shown in a report.
BADGES = {"low": "[LOW]", "medium": "[MED]", "high": "[HIGH]"}


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"')


def parquet(df: DataFrame, path: str, *partition_by: str) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def append(df: DataFrame, path: str) -> None:
    """New rows behind those that are there: issues, runs, model versions."""
    df.write.mode("append").parquet(path)


def jdbc(df: DataFrame, url: str, dbtable: str, mode: str = "append", **options: str) -> None:
    df.write.format("jdbc").options(url=url, dbtable=dbtable, **options).mode(mode).save()


def report_text(commit: Column, score: Column, level: Column, factors: Column, author: Column) -> Column:
    """A Markdown report of one scored commit: its hash cut to 12, the score to 4 places."""
    head = F.format_string("## Change risk %s\n\n| Field | Value |\n|---|---|\n| Commit | `%s` |\n", lookup(level, BADGES, "[UNK]"), F.substring(commit, 1, 12))
    who = F.when(F.length(author) > 0, F.concat(F.lit("| Author | "), author, F.lit(" |\n"))).otherwise("")
    body = F.format_string("| Score | %.4f |\n| Level | %s |\n\n", score, level)
    return F.concat(head, who, body, F.array_join(F.transform(factors, lambda x: F.concat(F.lit("- "), x)), "\n"))


def gate_lines(score: Column, level: Column) -> Column:
    """The lines that a gate reads: risk_score and risk_label."""
    return F.format_string("risk_score=%.4f\nrisk_label=%s", score, level)


def failure_details(text: Column) -> Column:
    return F.left(text, F.lit(500))


def keep_newest(files: DataFrame, group: str, moment: str, keep: int = 5) -> DataFrame:
    """Adds `keep`: whether a file is among its group's newest, equal times by path; the others may be deleted."""
    age = -F.unix_micros(F.col(moment).cast("timestamp"))
    ranked = sliced_running(files, [group], quantile_slices(files, age), [F.col(moment).desc(), F.col("path")], {"__place": F.lit(1).cast("bigint")})
    return ranked.withColumn("keep", F.col("__place") <= keep).select(*[c for c in files.columns if c != "keep"], "keep")


def run_record(run_id: Column, params: Column, metrics: Column) -> Column:
    """One experiment run as JSON."""
    return F.to_json(F.struct(run_id.alias("run_id"), params.alias("params"), metrics.alias("metrics")))
