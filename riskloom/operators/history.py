"""Commit history: touches, per-commit features and the re-touch label.

Defined results: a touch without any path is none; a commit without touches has
0 directories and is not labelled by touches; equal dates are ordered by
`seq`, then `ord`, then the touch's id, so a path twice in one commit touches
itself again, unless `distinct_per_commit` is set.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.columns import contains_any, dirname, first_filled, text_length, wall_time, within_days
from riskloom.operators.skew import earlier_rows, next_in_group

KEYWORDS = ("fix", "bug", "revert")


def explode_touches(commits: DataFrame) -> DataFrame:
    """One row per entry of `modified_files`, with its position as `ord`."""
    return commits.select("hash", "source_repo", F.col("author_date").alias("date"), "seq", F.posexplode("modified_files").alias("ord", "file")).select("hash", "source_repo", "date", "seq", "ord", "file.new_path", "file.old_path")


def with_path(touches: DataFrame) -> DataFrame:
    """Adds `path`, the new one or else the old one, and drops touches without."""
    return touches.withColumn("path", first_filled(F.col("new_path"), F.col("old_path"))).filter("path is not null")


def directories(touches: DataFrame) -> DataFrame:
    """(hash, dirs): distinct directories of a commit; files at the root add none.

    Distinct pairs come first, so the second aggregation meets each directory once
    and neither needs all touches of a large commit in one place.
    """
    pairs = with_path(touches).select("hash", dirname(F.col("path")).alias("dir")).filter("dir != ''").distinct()
    return pairs.groupBy("hash").agg(F.count(F.lit(1)).alias("dirs"))


def retouched(touches: DataFrame, days: int = 7, distinct_per_commit: bool = False) -> DataFrame:
    """(hash): commits of which a path is touched again within `days` whole days."""
    rows = with_path(touches).select("source_repo", "path", "date", "seq", "ord", "touch_id", "hash")
    if distinct_per_commit:
        rows = rows.groupBy("source_repo", "path", "hash").agg(F.min(F.struct("date", "seq", "ord", "touch_id")).alias("t")).select("source_repo", "path", "hash", "t.*")
    led = next_in_group(rows, ["source_repo", "path"], ["date", "seq", "ord", "touch_id"], "date", "next_date")
    return led.filter(within_days(F.col("date"), F.col("next_date"), days)).select("hash").distinct()


def labelled(commits: DataFrame, touches: DataFrame, days: int = 7, words: Sequence[str] = ("revert",), distinct_per_commit: bool = False) -> DataFrame:
    """Adds `label`: 1 if the commit is touched again in time or its message holds one of the words, else 0."""
    hit = retouched(touches, days, distinct_per_commit).withColumnRenamed("hash", "__hash")
    joined = commits.join(hit, commits["hash"] == hit["__hash"], "left")
    return joined.withColumn("label", (F.col("__hash").isNotNull() | contains_any(F.col("commit_msg"), words)).cast("int")).drop("__hash")


def observable(date: Column, newest: Column, days: int) -> Column:
    """Whether the label's window had passed when the history was read."""
    return within_days(date, newest, days - 1) == F.lit(False)


def derived_features(commits: DataFrame, touches: DataFrame, order: str = "seq", tie: str = "row_id") -> DataFrame:
    """Per commit row: files, directories, earlier commits of the author in the repository, hour, weekday, message length and keyword flag."""
    files = with_path(touches).groupBy("hash").agg(F.count(F.lit(1)).alias("files"))
    per_hash = files.join(directories(touches), "hash", "left").select(F.col("hash").alias("__hash"), "files", "dirs")
    group = F.when(F.col("author").isNotNull(), F.to_json(F.struct("source_repo", "author")))
    ranked = earlier_rows(commits.withColumn("__who", group), "__who", order, tie, "prior_commits").drop("__who")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("int").alias(c)
    return ranked.join(per_hash, F.col("hash") == F.col("__hash"), "left").select(
        tie, zero("files"), zero("dirs"), F.col("prior_commits"),
        F.hour("date").alias("hour"), F.weekday("date").alias("weekday"), text_length(F.col("commit_msg")).alias("msg_length"),
        contains_any(F.col("commit_msg"), KEYWORDS).cast("int").alias("keyword"),
    )


def features_of_commits(commits: DataFrame) -> DataFrame:
    """The feature row of nested commits, in the author's own wall time; counts are integers."""
    touches = explode_touches(commits)
    dirs = touches.withColumn("path", first_filled(F.col("new_path"), F.col("old_path"))).select("hash", dirname(F.col("path")).alias("dir")).filter("dir != ''").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("dirs"))
    ranked = earlier_rows(commits.withColumn("__who", F.to_json(F.struct("source_repo", "author"))), "__who", "seq", "hash", "prior")
    local = wall_time(F.col("author_date"), F.coalesce(F.col("tz_offset_s"), F.lit(0)))
    return ranked.join(dirs.withColumnRenamed("hash", "__hash"), F.col("hash") == F.col("__hash"), "left").select(
        "hash", "source_repo", "author", F.col("author_date").alias("date"), F.col("insertions").alias("lines_added"), F.col("deletions").alias("lines_deleted"),
        F.col("files").alias("files_touched"), F.coalesce("dirs", F.lit(0)).cast("int").alias("dirs_touched"), F.col("prior").cast("int").alias("author_prior_commits"),
        F.hour(local).alias("hour_of_day"), F.weekday(local).alias("day_of_week"), text_length(F.col("msg")).alias("commit_msg_length"),
        contains_any(F.col("msg"), KEYWORDS).cast("int").alias("is_fix_bug_revert"), F.coalesce("msg", F.lit("")).alias("commit_msg"),
    )


def single_commit(commits: DataFrame, commit_hash: str) -> DataFrame:
    """The feature row of one commit, without its message; its history counts. Raises ValueError if there is none."""
    found = features_of_commits(commits).filter(F.col("hash") == commit_hash).drop("commit_msg")
    if found.isEmpty():
        raise ValueError(f"no commit {commit_hash}")
    return found
