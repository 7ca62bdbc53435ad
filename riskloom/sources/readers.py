"""Readers. Schemas are given, so that a scan infers nothing and reads only the columns that are used."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.operators.quality import missing_columns


def csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV file with a header; quoted fields may hold line breaks."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"')


def inferred_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file of unknown columns: types are inferred, which reads it twice."""
    return spark.read.csv(path, header=True, inferSchema=True, multiLine=True, escape='"')


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def jdbc(spark: SparkSession, url: str, dbtable: str, key: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 16, **options: str) -> DataFrame:
    """A database table; with a numeric key and its bounds it is read in parallel."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=dbtable, **options)
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions)
    return reader.load()


def commits_since(commits: DataFrame, since: str, date: str = "date", order: str = "seq", most: int = 0) -> DataFrame:
    """Commits from a day on, in traversal order; `most` keeps the oldest so many, 0 all. The filter reaches the scan."""
    kept = commits.filter(F.col(date) >= F.lit(since).cast("timestamp_ntz")).orderBy(order)
    return kept.limit(most) if most else kept


def commit_by_hash(commits: DataFrame, commit_hash: str) -> DataFrame:
    """The rows of one commit; raises ValueError if there are none."""
    found = commits.filter(F.col("hash") == commit_hash)
    if found.isEmpty():
        raise ValueError(f"no commit {commit_hash}")
    return found


def cached(spark: SparkSession, path: str, schema: T.StructType, make) -> DataFrame:
    """The CSV file at a path if it is there and not empty; otherwise what `make()` gives."""
    at = Path(path)
    parts = [at] if at.is_file() else list(at.glob("part-*")) if at.is_dir() else []
    return csv(spark, path, schema) if any(p.stat().st_size for p in parts) else make()


def config(path: str | None, defaults: dict) -> dict:
    """A JSON or flat YAML file over defaults; the defaults where there is no file."""
    if not path or not Path(path).exists():
        return dict(defaults)
    text = Path(path).read_text()
    try:
        own = json.loads(text)
    except ValueError:
        own = _flat_yaml(text)
    return defaults | own


def _flat_yaml(text: str) -> dict:
    """Keys with scalars, lists of scalars and one level of nesting."""
    out: dict = {}
    at = None
    for line in text.splitlines():
        line = line.split(" #")[0].rstrip()
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        bare = line.strip()
        if bare.startswith("- "):
            if not isinstance(out.get(at), list):
                out[at] = []
            out[at].append(_scalar(bare[2:]))
            continue
        key, _, value = bare.partition(":")
        if line[0] != " ":
            at = key
            out[key] = _scalar(value.strip()) if value.strip() else {}
        elif isinstance(out.get(at), dict):
            out[at][key] = _scalar(value.strip())
    return out


def _scalar(text: str):
    t = text.strip().strip("\"'")
    for kind in (int, float):
        try:
            return kind(t)
        except ValueError:
            pass
    return {"true": True, "false": False, "null": None}.get(t.lower(), t)


def best_metrics(texts: DataFrame, column: str = "json") -> DataFrame:
    """(best_model, f1, accuracy, precision, recall) of comparison results as JSON texts; missing metrics are 0."""
    metric = "struct<f1:double,accuracy:double,precision:double,recall:double>"
    parsed = texts.select(F.from_json(column, f"best_model string, results map<string,{metric}>").alias("j"))
    own = F.try_element_at("j.results", "j.best_model")
    return parsed.select(F.col("j.best_model").alias("best_model"), *[F.coalesce(own[m], F.lit(0.0)).alias(m) for m in ("f1", "accuracy", "precision", "recall")])


def newest_file(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, modified) of the newest file of a folder; no row if there is none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "modificationTime")
    return files.agg(F.max_by("path", "modificationTime").alias("path"), F.max("modificationTime").alias("modified")).filter("path is not null")


def union_repos(parts: dict[str, DataFrame]) -> DataFrame:
    """All repositories' tables in one, with `source_repo` behind `hash`; empty or missing ones are skipped."""
    out = None
    for name, df in parts.items():
        if df is None:
            continue
        cols = [c for c in df.columns if c != "source_repo"]
        at = cols.index("hash") + 1 if "hash" in cols else 0
        own = df.select(*cols[:at], F.lit(name).alias("source_repo"), *cols[at:])
        out = own if out is None else out.unionByName(own)
    if out is None:
        raise ValueError("no repository gave a table")
    return out


def ordered_features(df: DataFrame, required: list[str]) -> DataFrame:
    if missing := missing_columns(df, required):
        raise ValueError(f"missing columns: {missing}")
    return df.select(*required)
