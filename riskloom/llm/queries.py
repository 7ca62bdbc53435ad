"""The queries of this subpackage, each over its whole tables, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import leakage, mixing, overlaps, personal, quantiles, sentences, splits
from riskloom.session import materialise, table

PROBABILITIES = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99}


def commits(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return table(spark, d, "commit_features").select(*columns)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = overlaps.cross_split_overlaps(commits(spark, d, "row_id", "hash", "commit_msg", "data_split"))
    return pairs.select(F.col("id_a").alias("row_id_a"), F.col("id_b").alias("row_id_b"))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return overlaps.overlap_report(commits(spark, d, "row_id", "hash", "commit_msg", "data_split", "source_repo", "risky"))


def p2_rows(spark: SparkSession, d: str) -> DataFrame:
    return overlaps.overlap_rows(commits(spark, d, "row_id", "hash", "commit_msg", "data_split", "risky"))


def p2_same_hash(spark: SparkSession, d: str) -> DataFrame:
    pairs = overlaps.hash_overlaps(commits(spark, d, "row_id", "hash", "data_split"), "row_id", "hash", "data_split")
    return pairs.select(F.col("id_a").alias("row_id_a"), F.col("id_b").alias("row_id_b"))


def commit_records() -> list[Column]:
    """What tells a commit: its hash, and seq, which numbers it also where its hash is null or another."""
    return [overlaps.hash_key("hash"), F.col("seq").cast("string")]


def by_author(spark: SparkSession, d: str) -> DataFrame:
    rows = splits.keyed_authors(commits(spark, d, "row_id", "hash", "seq", "author", "risky"), "author")
    return splits.assign_splits(rows, "row_id", F.col("author_key"), commit_records(), "risky")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.variant_pairs(by_author(spark, d), "author", "author_key")


def p3_split_by_author(spark: SparkSession, d: str) -> DataFrame:
    return by_author(spark, d).select("row_id", "split", "component")


def by_repo(spark: SparkSession, d: str) -> DataFrame:
    rows = commits(spark, d, "row_id", "hash", "seq", "source_repo", "risky")
    return splits.assign_splits(rows, "row_id", F.col("source_repo"), commit_records(), "risky")


def p3_split_by_repo(spark: SparkSession, d: str) -> DataFrame:
    return by_repo(spark, d).select("row_id", "split", "component")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Per unit and split: rows, their share, and the share of risky ones."""
    out = None
    for unit, make in (("author", by_author), ("source_repo", by_repo)):
        part = splits.split_report(materialise(make(spark, d), "assigned"), "risky").select(F.lit(unit).alias("unit"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def p3_together(spark: SparkSession, d: str) -> DataFrame:
    """Per unit: rows, authors or repositories, numbered commits, and how many of these lie in more than one split."""
    out = None
    for unit, key, make in (("author", "author", by_author), ("source_repo", "source_repo", by_repo)):
        done = materialise(make(spark, d), "assigned")
        units, numbered = (splits.torn(done, F.col(k)).select(F.struct("keys", "torn")).scalar() for k in (key, "seq"))
        part = done.agg(F.count("split").alias("n_rows")).select(F.lit(unit).alias("unit"), "n_rows", units["keys"].alias("units"), units["torn"].alias("torn_units"), numbered["keys"].alias("commits"), numbered["torn"].alias("torn_commits"))
        out = part if out is None else out.unionByName(part)
    return out


def p4_percentiles(spark: SparkSession, d: str) -> DataFrame:
    rows = commits(spark, d, "source_repo", "ingested_at", "lines_added", "lines_deleted")
    return quantiles.daily_and_combined(rows, F.to_date("ingested_at"), "source_repo", ["lines_added", "lines_deleted"], PROBABILITIES)


def texts(spark: SparkSession, d: str) -> DataFrame:
    """(table_name, row_key, text) of both tables with free text."""
    c = commits(spark, d, "row_id", "commit_msg").select(F.lit("commit_features").alias("table_name"), F.col("row_id").cast("bigint").alias("row_key"), F.col("commit_msg").alias("text"))
    i = table(spark, d, "issue").select(F.lit("issue").alias("table_name"), F.col("id").cast("bigint").alias("row_key"), F.col("details").alias("text"))
    return c.unionByName(i)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return personal.personal_types(texts(spark, d), ["table_name", "row_key"])


def p5_sanitised(spark: SparkSession, d: str) -> DataFrame:
    return personal.sanitised(texts(spark, d), "text").select("table_name", "row_key", "sanitised_text")


def documents(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return table(spark, d, "documents").select(*columns)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(documents(spark, d, "doc_id", "text"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "eval_items")
    return leakage.leak_report(leakage.leaked_items(documents(spark, d, "doc_id", "text"), items), items)


def mix(spark: SparkSession, d: str, *keep: str) -> DataFrame:
    return mixing.mix_sources(documents(spark, d, "doc_id", "text", "source"), table(spark, d, "source_targets"), keep=list(keep))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mix with its texts, in the order of a global shuffle."""
    return mix(spark, d, "doc_id", "text")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_report(mix(spark, d, "doc_id"), table(spark, d, "source_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_table(documents(spark, d, "doc_id", "text"))


QUERIES = {f.__name__: f for f in (p2_found, p2_rows, p2_report, p2_same_hash, p3_found, p3_split_by_author, p3_split_by_repo, p3_report, p3_together, p4_percentiles, p5_found, p5_sanitised, p7_found, p7_report, p8_mix, p8_report, p9_found)}

_STATE = """
  select source_repo, cast(ingested_at as date) as day, m.metric, m.value
  from (select source_repo, ingested_at, unnest([{'metric': 'lines_added', 'value': cast(lines_added as double)},
                                                 {'metric': 'lines_deleted', 'value': cast(lines_deleted as double)}]) as m
        from commit_features) where m.value >= 0"""
_RANKED = """
  select *, row_number() over (partition by source_repo, day, metric order by value) as r,
         count(*) over (partition by source_repo, day, metric) as n from ({state})"""
_PICK = ", ".join(f"min(case when r >= greatest(ceil({p} * n), 1) then value end) as {c}" for c, p in PROBABILITIES.items())

ORACLE_SQL = {
    "p2_same_hash": """
        with k as (select row_id, data_split, regexp_extract(lower(hash), '([0-9a-f]{12,40})', 1)[1:12] as h
                   from commit_features where data_split in ('train', 'validation', 'test'))
        select least(a.row_id, b.row_id) as row_id_a, greatest(a.row_id, b.row_id) as row_id_b
        from k a join k b on a.h = b.h and a.data_split = 'train' and b.data_split <> 'train' where length(a.h) = 12""",
    "p3_found": r"""
        with k as (select distinct author, array_to_string(list_sort(regexp_extract_all(strip_accents(lower(nfc_normalize(
                     regexp_replace(author, '<[^<>]*>|\([^()]*\)|\[[^\[\]]*\]|\S+@\S+', ' ', 'g')))), '[\pL\pN]+')), ' ') as name
                   from commit_features where author is not null)
        select a.author as author_a, b.author as author_b from k a join k b on a.name = b.name and a.author < b.author""",
    "p3_together": """
        select 'author' as unit, count(*) as n_rows, count(distinct author) as units, 0 as torn_units, count(distinct seq) as commits, 0 as torn_commits from commit_features
        union all select 'source_repo', count(*), count(distinct source_repo), 0, count(distinct seq), 0 from commit_features""",
    "p4_percentiles": f"""
        with s as ({_STATE}), a as (select source_repo, day, metric, value from s union all select source_repo, cast(null as date), metric, value from s),
        k as ({_RANKED.format(state="select * from a")})
        select source_repo, day, metric, max(n) as n_values, {_PICK} from k group by source_repo, day, metric""",
}
