"""Explicit schemas of the tables; nothing is inferred outside `sources.inferred_csv`."""

from pyspark.sql import types as T

FEATURES = ("lines_added", "lines_deleted", "files_touched", "dirs_touched", "author_prior_commits", "hour_of_day", "day_of_week", "commit_msg_length", "is_fix_bug_revert")

TOUCH = T.StructType([T.StructField("new_path", T.StringType()), T.StructField("old_path", T.StringType())])

COMMIT = T.StructType([
    T.StructField("hash", T.StringType()), T.StructField("source_repo", T.StringType()), T.StructField("author", T.StringType()),
    T.StructField("author_date", T.TimestampType()), T.StructField("tz_offset_s", T.IntegerType()), T.StructField("seq", T.LongType()),
    T.StructField("insertions", T.IntegerType()), T.StructField("deletions", T.IntegerType()), T.StructField("files", T.IntegerType()),
    T.StructField("modified_files", T.ArrayType(TOUCH)), T.StructField("msg", T.StringType()),
])

FEATURE_ROW = T.StructType([
    T.StructField("hash", T.StringType()), T.StructField("author", T.StringType()), T.StructField("date", T.TimestampNTZType()),
    *[T.StructField(c, T.IntegerType()) for c in FEATURES], T.StructField("commit_msg", T.StringType()), T.StructField("risky", T.IntegerType()),
])

ISSUE = T.StructType([
    T.StructField("id", T.IntegerType()), T.StructField("gate", T.IntegerType()), T.StructField("type", T.StringType()), T.StructField("repo", T.StringType()),
    T.StructField("status", T.StringType()), T.StructField("details", T.StringType()), T.StructField("commit_hash", T.StringType()),
    T.StructField("risk_score", T.IntegerType()), T.StructField("created_at", T.TimestampNTZType()), T.StructField("updated_at", T.TimestampNTZType()),
])

MODEL_VERSION = T.StructType([T.StructField("version", T.StringType()), T.StructField("run_id", T.StringType()), T.StructField("stage", T.StringType()), T.StructField("f1", T.DoubleType())])

REQUEST = T.StructType([T.StructField(c, T.IntegerType()) for c in FEATURES])
