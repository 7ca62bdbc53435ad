"""Queries of the general data problems: skewed keys and mixed timestamps, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.instants import normalise_instants
from riskloom.operators.skew import earlier_rows, salted_aggregate, salted_count
from riskloom.session import scalars, table

HEAVY = 0.04


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Keys that hold at least 4 % of a table's rows, from salted counts."""
    out = None
    for name, key, row in (("commit_features", "author", "row_id"), ("issue", "repo", "id")):
        rows = table(spark, d, name).select(key, row)
        counts = salted_count(rows, key, [row])
        part = counts.filter(F.col(key).isNotNull() & (F.col("n") >= HEAVY * scalars(rows, n=F.count(F.lit(1)))["n"]))
        part = part.select(F.lit(name).alias("table_name"), F.col(key).alias("key_value"))
        out = part if out is None else out.unionByName(part)
    return out


def p1_author_results(spark: SparkSession, d: str) -> DataFrame:
    """Per author: commits, risky commits and share, and the first and last arrival."""
    rows = table(spark, d, "commit_features").select("row_id", "author", "risky", "ingested_at")
    risky = F.col("risky") == 1
    done = salted_aggregate(
        rows, "author",
        {"c": F.count(F.lit(1)), "r": F.count_if(risky), "k": F.count("risky"), "a": F.min("ingested_at"), "z": F.max("ingested_at")},
        {"commits": F.sum("c"), "risky_commits": F.sum("r"), "labelled": F.sum("k"), "first_seen": F.min("a"), "last_seen": F.max("z")},
        salt_on=["row_id"],
    )
    return done.select("author", "commits", "risky_commits", F.try_divide("risky_commits", "labelled").alias("risky_share"), "first_seen", "last_seen")


def p1_repo_issues(spark: SparkSession, d: str) -> DataFrame:
    """Per repository: issues, open and resolved ones, and the sum of known scores."""
    rows = table(spark, d, "issue").select("id", "repo", "status", "risk_score")
    return salted_aggregate(
        rows, "repo",
        {"i": F.count(F.lit(1)), "o": F.count_if(F.col("status") == "open"), "r": F.count_if(F.col("status") == "resolved"), "s": F.sum(F.col("risk_score").cast("bigint"))},
        {"issues": F.sum("i"), "open_issues": F.sum("o"), "resolved_issues": F.sum("r"), "score_sum": F.sum("s")},
        salt_on=["id"],
    )


def p1_earlier_commits(spark: SparkSession, d: str) -> DataFrame:
    """Per row: earlier rows of the same author, in the order of seq and row_id."""
    rows = table(spark, d, "commit_features").select("row_id", "author", "seq")
    return earlier_rows(rows, "author", "seq", "row_id", "earlier_commits").select("row_id", "earlier_commits")


def instants(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "commit_features").select("row_id", "date_text", "author_tz", "day_of_week")
    return normalise_instants(rows, "date_text", "author_tz", "day_of_week")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose author date is exactly one instant."""
    return instants(spark, d).filter("utc_epoch_us is not null").select("row_id", F.col("utc_epoch_us").alias("epoch_us"))


def p6_normalised(spark: SparkSession, d: str) -> DataFrame:
    """Every row, with its instant in UTC and the author's hour and weekday."""
    return instants(spark, d).select("row_id", "utc_instant", "utc_hour_of_day", "utc_day_of_week")


QUERIES = {f.__name__: f for f in (p1_found, p1_author_results, p1_repo_issues, p1_earlier_commits, p6_found, p6_normalised)}
ORACLE_SQL = {
    "p1_found": """
        select 'commit_features' as table_name, author as key_value from commit_features where author is not null
        group by author having count(*) >= 0.04 * (select count(*) from commit_features)
        union all select 'issue', repo from issue where repo is not null group by repo having count(*) >= 0.04 * (select count(*) from issue)""",
    "p1_author_results": """
        select author, count(*) as commits, count(*) filter (where risky = 1) as risky_commits,
               count(*) filter (where risky = 1) / nullif(count(risky), 0) as risky_share, min(ingested_at) as first_seen, max(ingested_at) as last_seen
        from commit_features group by author""",
    "p1_repo_issues": """
        select repo, count(*) as issues, count(*) filter (where status = 'open') as open_issues,
               count(*) filter (where status = 'resolved') as resolved_issues, cast(sum(risk_score) as bigint) as score_sum from issue group by repo""",
    "p1_earlier_commits": """
        select row_id, case when author is not null then row_number() over (partition by author order by seq nulls first, row_id) - 1 end as earlier_commits
        from commit_features""",
}
