"""One query per operator of the inventory, each over its whole tables, and its SQL."""

from __future__ import annotations

import zlib
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions import columns as C
from riskloom.operators import featurestore, history, issues, metrics, models, quality, registry, sampling, timeseries
from riskloom.schemas import FEATURES
from riskloom.session import materialise, scalars, table
from riskloom.sources import readers, sinks
from riskloom.streaming import streams

NOW = datetime(2024, 5, 1)
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query, and its SQL where there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def commits(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "commit_features")


def touches(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "file_touches")


def issue(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "issue")


def predicted(s: SparkSession, d: str, *more: str) -> DataFrame:
    """A stand-in for predictions: the keyword flag."""
    return commits(s, d).select("row_id", "risky", F.col("is_fix_bug_revert").alias("prediction"), *more)


_PATH = "coalesce(nullif(new_path, ''), nullif(old_path, ''))"
_TOUCH = f"(select *, {_PATH} as path from file_touches where {_PATH} is not null)"
_AGAIN = f"""(select distinct hash from (select hash, date, lead(date) over (partition by source_repo, path order by date, seq, ord, touch_id) as nx from {_TOUCH})
    where nx < date + interval 8 days)"""
_LABEL = f"""(select c.*, case when a.hash is not null or contains(lower(coalesce(c.commit_msg, '')), 'revert') then 1 else 0 end as label
    from commit_features c left join {_AGAIN} a on c.hash = a.hash)"""

# --- sources and sinks -------------------------------------------------------


@query("select row_id, hash, seq from commit_features where date >= timestamp '2022-01-01' order by seq, row_id")
def src1_commits_since(s, d):
    return readers.commits_since(commits(s, d).select("row_id", "hash", "seq", "date"), "2022-01-01").select("row_id", "hash", "seq")


@query("select row_id, hash, author, lines_added from commit_features where hash = (select min(hash) from commit_features)")
def src2_commit_by_hash(s, d):
    least = commits(s, d).agg(F.min("hash").alias("h")).first()["h"]
    return readers.commit_by_hash(commits(s, d), least).select("row_id", "hash", "author", "lines_added")


@query("select version, run_id, stage, f1 from model_versions")
def src4_csv_round_trip(s, d):
    """Written as CSV and read again with the schema."""
    from riskloom.schemas import MODEL_VERSION
    from riskloom.session import shared_dir

    at = f"{shared_dir(s).rstrip('/')}/riskloom-csv-round-trip-{zlib.crc32(d.encode())}"
    sinks.csv(table(s, d, "model_versions"), at)
    return readers.csv(s, at, MODEL_VERSION)


@query("select id, repo, status, details, risk_score from issue")
def snk5_json_round_trip(s, d):
    """Written as JSON lines and read again with the schema."""
    from riskloom.schemas import ISSUE
    from riskloom.session import shared_dir

    at = f"{shared_dir(s).rstrip('/')}/riskloom-json-round-trip-{zlib.crc32(d.encode())}"
    sinks.json_lines(issue(s, d), at)
    return readers.json_lines(s, at, ISSUE).select("id", "repo", "status", "details", "risk_score")


@query("select touch_id, hash, source_repo from file_touches")
def snk2_parquet_round_trip(s, d):
    return materialise(touches(s, d).select("touch_id", "hash", "source_repo"), "round-trip")


@query("select 'm2' as best_model, cast(0.7 as double) as f1, cast(0.8 as double) as accuracy, cast(0 as double) as precision, cast(0 as double) as recall")
def src9_best_metrics(s, d):
    text = '{"best_model": "m2", "results": {"m1": {"f1": 0.5}, "m2": {"f1": 0.7, "accuracy": 0.8}}}'
    return readers.best_metrics(s.createDataFrame([(text,)], "json string"))


@query("""select id, gate, type, repo, status from issue union all select 2000000001, 2, 'drift', 'new/repo', 'open'""")
def snk3_insert_issue(s, d):
    """One valid new row is inserted, one with a wrong gate and one without a repository are not."""
    from riskloom.schemas import ISSUE

    at = datetime(2024, 5, 1)
    rows = [(2_000_000_001, 2, "drift", "new/repo", "open", None, None, None, at, at), (2_000_000_002, 7, "drift", "new/repo", "open", None, None, None, at, at), (2_000_000_003, 1, "drift", None, "open", None, None, None, at, at)]
    return issues.insert(issue(s, d), s.createDataFrame(rows, ISSUE)).select("id", "gate", "type", "repo", "status")


@query("""select id, case when id = 1 then case when status = 'open' then 'resolved' else 'open' end else status end as status,
          case when id = 1 then timestamp '2024-05-01' else updated_at end as updated_at from issue""")
def snk4_toggle_issue(s, d):
    return issues.toggled(issue(s, d), 1, NOW).select("id", "status", "updated_at")


@query("""select row_id, printf('risk_score=%.4f' || chr(10) || 'risk_label=%s', p, case when p < 0.3 then 'low' when p <= 0.6 then 'medium' else 'high' end) as lines
          from (select row_id, coalesce(abs(lines_added) % 100, 0) / 100.0::double as p from commit_features)""")
def snk8_gate_lines(s, d):
    score = (F.coalesce(F.abs("lines_added") % 100, F.lit(0)) / 100.0).cast("double")
    return commits(s, d).select("row_id", sinks.gate_lines(score, C.risk_level(score)).alias("lines"))


_FACTORS = """list_filter([case when files_touched > 5 then files_touched || ' files touched' end,
      case when coalesce(lines_added, 0) + coalesce(lines_deleted, 0) > 100 then (coalesce(lines_added, 0) + coalesce(lines_deleted, 0)) || ' lines changed' end,
      case when hour_of_day < 6 or hour_of_day > 22 then 'changed at ' || hour_of_day || ':00 (late night/early morning)' when hour_of_day < 8 then 'changed at ' || hour_of_day || ':00 (early morning)' end,
      case when coalesce(author_prior_commits, 0) = 0 then 'first-time contributor' when author_prior_commits between 1 and 4 then 'new contributor (' || author_prior_commits || ' prior commits)' end,
      case when is_fix_bug_revert = 1 then 'commit message contains fix/bug/revert keywords' end, case when dirs_touched > 5 then 'spans ' || dirs_touched || ' directories' end], lambda x: x is not null)[1:3]"""
_SCORED = "(select *, coalesce(abs(lines_added) % 100, 0) / 100.0::double as p from commit_features)"


@query(f"""select row_id, '## Change risk ' || case when p < 0.3 then '[LOW]' when p <= 0.6 then '[MED]' else '[HIGH]' end || chr(10) || chr(10) || '| Field | Value |' || chr(10) || '|---|---|' || chr(10)
           || '| Commit | `' || left(coalesce(hash, ''), 12) || '` |' || chr(10) || case when coalesce(author, '') <> '' then '| Author | ' || author || ' |' || chr(10) else '' end
           || printf('| Score | %.4f |', p) || chr(10) || '| Level | ' || case when p < 0.3 then 'low' when p <= 0.6 then 'medium' else 'high' end || ' |' || chr(10) || chr(10)
           || array_to_string(list_transform(case when len(f) > 0 then f else ['no notable risk factors'] end, lambda x: '- ' || x), chr(10)) as report
           from (select *, {_FACTORS} as f from {_SCORED})""")
def snk7_markdown_report(s, d):
    score = (F.coalesce(F.abs("lines_added") % 100, F.lit(0)) / 100.0).cast("double")
    return commits(s, d).select("row_id", sinks.report_text(F.coalesce("hash", F.lit("")), score, C.risk_level(score), C.notable_factors(), F.coalesce("author", F.lit(""))).alias("report"))


@query("""select touch_id, row_number() over (partition by source_repo order by date desc, path) <= 5 as keep
          from (select touch_id, source_repo, date, cast(touch_id as varchar) as path from file_touches)""")
def snk10_keep_newest(s, d):
    files = touches(s, d).select("touch_id", "source_repo", "date", F.col("touch_id").cast("string").alias("path"))
    return sinks.keep_newest(files, "source_repo", "date").select("touch_id", "keep")


# --- projections, filters, scalar functions ----------------------------------


@query("select row_id, " + ", ".join(FEATURES) + ", risky from commit_features")
def prj1_features_and_target(s, d):
    df = quality.features_and_target(commits(s, d), ["row_id", *FEATURES])
    return df


@query("""select row_id, hash, hash as commit_hash, source_repo, 'fixed' as origin from commit_features""")
def prj2_columns(s, d):
    """Dropped, moved, aliased and constant columns."""
    df = commits(s, d).select("row_id", "hash", "author", "source_repo", "commit_msg").drop("commit_msg", "no_such_column")
    df = quality.with_alias(quality.column_after(df, "source_repo", "hash"), "hash", "commit_hash").withColumn("origin", F.lit("fixed"))
    return df.select("row_id", "hash", "commit_hash", "source_repo", "origin")


@query("select unnest(['lines_added','lines_deleted','files_touched','dirs_touched','author_prior_commits','hour_of_day','day_of_week','commit_msg_length','is_fix_bug_revert','seq']) as column_name")
def prj6_numeric_columns(s, d):
    names = quality.numeric_columns(commits(s, d), ("row_id", "risky"))
    return s.createDataFrame([(n,) for n in names], "column_name string")


def _json(column: str, kind: str = "text") -> str:
    value = {"text": f"to_json({column})::varchar", "number": f"cast({column} as varchar)", "time": f"'\"' || strftime({column}, '%Y-%m-%dT%H:%M:%S.%f') || '\"'"}[kind]
    return f"""'"{column}":' || coalesce({value}, 'null')"""


@query("select id, '{' || " + " || ',' || ".join(_json(c, k) for c, k in (("id", "number"), ("gate", "number"), ("type", "text"), ("repo", "text"), ("status", "text"), ("details", "text"), ("commit_hash", "text"), ("risk_score", "number"), ("created_at", "time"), ("updated_at", "time"))) + " || '}' as json from issue")
def prj7_row_json(s, d):
    """Whole rows as JSON, times in ISO form, nulls kept."""
    return issues.as_json(issue(s, d))


@query("""select row_id, coalesce(lines_added, 0) as lines_added, coalesce(hash, '') as commit_hash from commit_features""")
def prj8_defaults(s, d):
    return commits(s, d).select("row_id", F.coalesce("lines_added", F.lit(0)).alias("lines_added"), F.coalesce("hash", F.lit("")).alias("commit_hash"))


@query("select id, status, repo from issue where status = 'open' and repo = 'orchardlab/quillnet'")
def flt1_optional_filters(s, d):
    return issues.filtered(issue(s, d), "open", "orchardlab/quillnet").select("id", "status", "repo")


@query("select id, created_at from issue where created_at >= timestamp '2024-05-01' - interval 30 days")
def flt2_time_range(s, d):
    return issues.since(issue(s, d), NOW, 30).select("id", "created_at")


@query("select row_id, date from commit_features where date is not null")
def flt4_null_dates(s, d):
    return featurestore.prepared(commits(s, d)).select("row_id", "date")


@query("select event_id, event_type from events where regexp_full_match(event_type, 'error|click')")
def flt6_label_pattern(s, d):
    return timeseries.matching(table(s, d, "events"), "event_type", "error|click").select("event_id", "event_type")


@query("""select row_id, cast(contains(m, 'fix') or contains(m, 'bug') or contains(m, 'revert') as int) as keyword, cast(length(m0) as int) as msg_length
          from (select row_id, lower(coalesce(commit_msg, '')) as m, coalesce(commit_msg, '') as m0 from commit_features)""")
def flt7_keywords(s, d):
    return commits(s, d).select("row_id", C.contains_any(F.col("commit_msg"), history.KEYWORDS).cast("int").alias("keyword"), C.text_length(F.col("commit_msg")).alias("msg_length"))


@query(f"select touch_id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) as dir from {_TOUCH}")
def str3_paths(s, d):
    return history.with_path(touches(s, d)).select("touch_id", "path", C.dirname(F.col("path")).alias("dir"))


@query("""select row_id, replace(split_part(source_repo, '/', -1), '.git', '') as repo, hash[1:12] as short_hash, left(commit_msg, 500) as cut from commit_features""")
def str5_text_parts(s, d):
    url = F.concat(F.lit("https://git.example/"), F.col("source_repo"), F.lit(".git/"))
    return commits(s, d).select("row_id", C.repo_name(url).alias("repo"), F.substring("hash", 1, 12).alias("short_hash"), sinks.failure_details(F.col("commit_msg")).alias("cut"))


@query("""select source_repo, string_agg(x, '+' order by i) as joined from (
            select source_repo, trim(x) as x, i from (select source_repo, unnest(string_split(source_repo || ', ,b', ',')) as x, generate_subscripts(string_split(source_repo || ', ,b', ','), 1) as i from (select distinct source_repo from commit_features where source_repo is not null)))
          where x <> '' group by source_repo""")
def str6_lists(s, d):
    repos = commits(s, d).select("source_repo").filter("source_repo is not null").distinct()
    return repos.select("source_repo", F.array_join(C.split_list(F.concat("source_repo", F.lit(", ,b"))), "+").alias("joined"))


@query("""select id, case when contains(details, 'schema') then 'schema' when contains(details, 'sanity') then 'sanity' when contains(details, 'latency') then 'latency'
          when contains(details, 'drift') then 'drift' else 'other' end as kind from issue""")
def str10_first_match(s, d):
    cases = [(x, x) for x in ("schema", "sanity", "latency", "drift")]
    return issue(s, d).select("id", C.first_match(F.col("details"), cases, "other").alias("kind"))


@query("""select row_id, cast(hour(date) as int) as hour, cast(isodow(date) - 1 as int) as weekday, cast(date as date) as day, strftime(date, '%Y%m%d-%H%M%S') as stamp from commit_features""")
def dt1_wall_clock(s, d):
    return commits(s, d).select("row_id", F.hour("date").alias("hour"), C.monday_weekday(F.col("date")).alias("weekday"), F.to_date("date").alias("day"), F.date_format("date", "yyyyMMdd-HHmmss").alias("stamp"))


@query("""select id, cast(floor((epoch_us(updated_at) - epoch_us(created_at)) / 86400000000.0) as bigint) as days from issue""")
def dt3_whole_days(s, d):
    return issue(s, d).select("id", C.whole_days(F.col("created_at"), F.col("updated_at")).alias("days"))


@query("""select row_id, day, case when regexp_full_match(date_text, '[0-9]{4}-[0-9]{2}-[0-9]{2}') then try_strptime(date_text, '%Y-%m-%d') end as strict_day from
          (select row_id, date_text, case when regexp_matches(date_text, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') then try_strptime(left(date_text, 10), '%Y-%m-%d') end as day from commit_features)""")
def dt4_parse_days(s, d):
    """The day that the text begins with, and the day where the text is nothing else."""
    return commits(s, d).select("row_id", C.parse_day(F.regexp_extract("date_text", r"^(\d{4}-\d{2}-\d{2})", 1)).alias("day"), C.parse_day(F.col("date_text")).alias("strict_day"))


@query("""select id, case when s < 0.3 then 'low' when s <= 0.6 then 'medium' when s is not null then 'high' end as level, cast(trunc(s * 100) as int) as percent,
          coalesce(case when s < 0.3 then '[LOW]' when s <= 0.6 then '[MED]' when s is not null then '[HIGH]' end, '[UNK]') as badge from (select id, risk_score / 100::double as s from issue)""")
def mth1_levels(s, d):
    score = (F.col("risk_score") / 100).cast("double")
    df = issue(s, d).select("id", score.alias("s"))
    level = C.risk_level(F.col("s"))
    return df.select("id", level.alias("level"), C.percent(F.col("s")).alias("percent"), C.lookup(level, sinks.BADGES, "[UNK]").alias("badge"))


@query(f"select row_id, case when len(f) > 0 then array_to_string(f, ', ') else 'no notable risk factors' end as labels from (select row_id, {_FACTORS} as f from commit_features)")
def cnd1_first_labels(s, d):
    """The first three notable things of each change."""
    return commits(s, d).select("row_id", F.array_join(C.notable_factors(), ", ").alias("labels"))


@query("select event_id, cast(props->>'k' as int) as k from events")
def jsn1_decode(s, d):
    return table(s, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("""with k as (select hash, source_repo, count(*) as n from file_touches group by hash, source_repo) select hash, source_repo, n from k""")
def arr1_explode_files(s, d):
    """Commits with their lists of files, exploded again and counted per commit. A list holds 200 files at most; a commit with more has several rows."""
    piece = F.floor(F.col("ord") / 200)
    nested = touches(s, d).groupBy("hash", "source_repo", F.col("date").alias("author_date"), "seq", piece.alias("piece")).agg(F.collect_list(F.struct("new_path", "old_path")).alias("modified_files"))
    return history.explode_touches(nested).groupBy("hash", "source_repo").agg(F.count(F.lit(1)).alias("n"))


# --- history: labels and features --------------------------------------------


@query(f"select row_id, label from {_LABEL}")
def win2_retouch_label(s, d):
    return history.labelled(commits(s, d).select("row_id", "hash", "commit_msg"), touches(s, d)).select("row_id", "label")


@query(f"""select source_repo, count(*) as n, count(*) filter (where label = 1) as positives, count(*) filter (where label = 0) as negatives,
           count(*) filter (where label = 1) * 100 / count(*)::double as positive_pct from {_LABEL} group by source_repo""")
def win2_label_balance(s, d):
    return metrics.class_balance(history.labelled(commits(s, d).select("row_id", "hash", "source_repo", "commit_msg"), touches(s, d)), "label", ("source_repo",))


@query(f"""select distinct hash from (select hash, date, lead(date) over (partition by source_repo, path order by date, seq, ord, touch_id) as nx from (
             select source_repo, path, hash, date, seq, ord, touch_id from {_TOUCH} qualify row_number() over (partition by source_repo, path, hash order by date, seq, ord, touch_id) = 1))
           where nx < date + interval 8 days""")
def jn1_distinct_retouches(s, d):
    return history.retouched(touches(s, d), distinct_per_commit=True)


@query(f"""select hash, count(distinct dir) as dirs from (select hash, regexp_extract(path, '^(.*)/[^/]*$', 1) as dir from {_TOUCH}) where dir <> '' group by hash""")
def agg1_directories(s, d):
    return history.directories(touches(s, d))


@query(f"""select row_id, cast(coalesce(files, 0) as int) as files, cast(coalesce(dirs, 0) as int) as dirs,
             case when author is not null then row_number() over (partition by source_repo, author order by seq nulls first, row_id) - 1 end as prior_commits,
             cast(hour(date) as int) as hour, cast(isodow(date) - 1 as int) as weekday, cast(length(coalesce(commit_msg, '')) as int) as msg_length,
             cast(contains(lower(coalesce(commit_msg, '')), 'fix') or contains(lower(coalesce(commit_msg, '')), 'bug') or contains(lower(coalesce(commit_msg, '')), 'revert') as int) as keyword
           from commit_features c left join (select hash as h, count(*) as files, count(distinct nullif(regexp_extract(path, '^(.*)/[^/]*$', 1), '')) as dirs from {_TOUCH} group by hash) t on c.hash = t.h""")
def win1_features(s, d):
    rows = commits(s, d).select("row_id", "hash", "source_repo", "author", "seq", "date", "commit_msg")
    return history.derived_features(rows, touches(s, d))


@query(f"select row_id, cast(a.hash is not null as int) as touched_again from commit_features c left join {_AGAIN} a on c.hash = a.hash")
def jn2_semi_join_flag(s, d):
    hit = history.retouched(touches(s, d)).withColumnRenamed("hash", "h")
    return commits(s, d).select("row_id", "hash").join(hit, F.col("hash") == F.col("h"), "left").select("row_id", F.col("h").isNotNull().cast("int").alias("touched_again"))


@query("""select row_id, hash, case when data_split is null then 'none' else data_split end as source_repo from commit_features where data_split in ('train', 'validation', 'test') or data_split is null""")
def set1_union_repos(s, d):
    """The parts of the table as tables of repositories named after them, in one table again, the name behind the hash."""
    df = commits(s, d).select("row_id", "hash", "data_split")
    parts = {name: df.filter(F.col("data_split").eqNullSafe(F.lit(None if name == "none" else name))).drop("data_split") for name in ("train", "validation", "test", "none")}
    return readers.union_repos(parts | {"missing": None})


# --- aggregates ---------------------------------------------------------------


@query("""select count(*) as n, count(*) filter (where risky = 1) as positives, count(*) filter (where risky = 0) as negatives,
          count(*) filter (where risky = 1) * 100 / count(*)::double as positive_pct from commit_features where risky is not null""")
def agg2_class_balance(s, d):
    return metrics.class_balance(commits(s, d), "risky")


@query("""select r.source_repo, coalesce(n, 0) as n, coalesce(positives, 0) as positives, coalesce(negatives, 0) as negatives, coalesce(positives * 100 / n::double, 0) as positive_pct
          from (select distinct source_repo from file_touches union all select 'none/such') r left join (
            select source_repo, count(*) as n, count(*) filter (where risky = 1) as positives, count(*) filter (where risky = 0) as negatives from commit_features where risky is not null group by source_repo) c
          on r.source_repo = c.source_repo""")
def agg3_per_listed_repo(s, d):
    listed = touches(s, d).select("source_repo").distinct().unionByName(s.createDataFrame([("none/such",)], "source_repo string"))
    return metrics.per_listed_group(commits(s, d), "risky", "source_repo", listed)


@query("select source as value, count(*) / sum(count(*)) over () as share from documents where source is not null group by source")
def agg4_value_shares(s, d):
    return metrics.value_shares(table(s, d, "documents"), "source")


@query("select count(*) as n_rows, count(*) filter (where date_text is null or not regexp_matches(date_text, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$')) as not_a_day from commit_features")
def flt4_dropped_times(s, d):
    """How many rows the preparation of the store drops, if it is given the days that texts hold."""
    return featurestore.unreadable(commits(s, d).select(C.parse_day(F.col("date_text")).alias("date"))).withColumnRenamed("dropped", "not_a_day")


@query("""select cast(created_at as date) as day, count(*) filter (where status = 'open') as open, count(*) filter (where status = 'resolved') as resolved
          from issue where created_at >= timestamp '2024-05-01' - interval 400 days group by 1""")
def agg5_daily_status(s, d):
    return issues.daily_counts(issue(s, d), NOW, 400)


@query("select count(*) filter (where status = 'open') as open, count(*) filter (where status = 'resolved') as resolved, count(*) filter (where status in ('open', 'resolved')) as total from issue")
def agg6_status_totals(s, d):
    return issues.totals(issue(s, d))


@query("select type, count(*) filter (where status = 'open') as open, count(*) filter (where status = 'resolved') as resolved from issue group by type")
def agg7_by_type(s, d):
    return issues.by_type(issue(s, d))


@query("select 'gate_' || gate as gate, count(*) filter (where status = 'open') as open, count(*) filter (where status = 'resolved') as resolved from issue group by gate")
def agg8_by_gate(s, d):
    return issues.by_gate(issue(s, d))


@query("select count(*) as n from issue where status = 'open'")
def agg9_filtered_count(s, d):
    return issues.filtered(issue(s, d), "open").agg(F.count(F.lit(1)).alias("n"))


_FAIR = """(select case when author_prior_commits < 5 then 'new' else 'experienced' end as grp, count(*) as n, avg((risky = 1)::int::double) as actual_rate,
          avg((is_fix_bug_revert = 1)::int::double) as predicted_rate, avg((risky = is_fix_bug_revert)::int::double) as accuracy
          from commit_features where risky is not null and is_fix_bug_revert is not null group by 1)"""


def _fairness(s, d):
    return metrics.group_fairness(predicted(s, d, "author_prior_commits"), F.when(F.col("author_prior_commits") < 5, "new").otherwise("experienced"), "risky", "prediction")


@query(f"select grp, n, actual_rate, predicted_rate, accuracy from {_FAIR}")
def agg10_group_fairness(s, d):
    return _fairness(s, d)


@query(f"""select abs(max(case when grp = 'new' then predicted_rate end) - max(case when grp = 'experienced' then predicted_rate end)) as difference,
           abs(max(case when grp = 'new' then predicted_rate end) - max(case when grp = 'experienced' then predicted_rate end)) < 0.1 as passes from {_FAIR}""")
def agg11_parity(s, d):
    return metrics.parity(_fairness(s, d), "new", "experienced", 0.1)


@query("""select n, (tp + tn) / n::double as accuracy, coalesce(tp / nullif(tp + fp, 0)::double, 0) as precision, coalesce(tp / nullif(tp + fn, 0)::double, 0) as recall,
          coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::double, 0) as f1 from (select count(*) as n, count(*) filter (where r = 1 and p = 1) as tp, count(*) filter (where r <> 1 and p = 1) as fp,
          count(*) filter (where r = 1 and p <> 1) as fn, count(*) filter (where r <> 1 and p <> 1) as tn from (select risky as r, is_fix_bug_revert as p from commit_features where risky is not null and is_fix_bug_revert is not null))""")
def agg12_classification(s, d):
    return metrics.classification(predicted(s, d), "risky", "prediction")


@query("""select count(value) as n, avg(value) as mean, min(value) as least, max(value) as most, list_sort(list(value))[cast(least(floor(0.95 * count(value)), count(value) - 1) as int) + 1] as quantile
          from events where value is not null""")
def agg13_latency(s, d):
    return metrics.latency_summary(table(s, d, "events"), "value")


@query("""select source_repo, row_id, lines_added from (select source_repo, row_id, lines_added,
          row_number() over (partition by source_repo order by lines_added desc nulls last, row_id) as k from commit_features) where k = 1""")
def agg14_best_per_group(s, d):
    return metrics.best_by(commits(s, d).select("source_repo", "row_id", "lines_added"), "lines_added", "row_id", ("source_repo",))


@query("select version, run_id, stage, f1 from model_versions where stage = 'Production' order by cast(version as int) desc limit 1")
def agg15_production_version(s, d):
    return registry.production(table(s, d, "model_versions"))


@query("select event_type, sum(value) as total from events group by event_type")
def agg16_sum_by_label(s, d):
    return timeseries.sum_by(table(s, d, "events"), "event_type", "value")


_BOUNDS = [5.0, 10.0, 25.0, 50.0, 100.0, 250.0]


def _interpolated(q: float) -> str:
    cases = []
    for i, b in enumerate(_BOUNDS):
        lo, below = (_BOUNDS[i - 1], f"count(*) filter (where value <= {_BOUNDS[i - 1]})") if i else (0.0, "0")
        le = f"count(*) filter (where value <= {b})"
        cases.append(f"when {le} >= {q} * count(*) then {lo} + {b - lo} * (({q} * count(*) - {below}) / nullif({le} - {below}, 0)::double)")
    return "case " + " ".join(cases) + f" else {_BOUNDS[-1]} end"


@query(f"select count(*) as n, {_interpolated(0.5)} as p50, {_interpolated(0.95)} as p95, {_interpolated(0.99)} as p99 from events where value is not null")
def agg17_histogram_quantiles(s, d):
    return metrics.histogram_quantiles(table(s, d, "events"), "value", _BOUNDS, {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query("select distinct repo from (select repo from issue order by created_at desc nulls last, id desc limit 100)")
def agg18_repos_of_page(s, d):
    """The repositories of the first page; the page is the feature."""
    return issues.page(issue(s, d)).select("repo").distinct()


# --- windows, sorting, splits -------------------------------------------------


@query("""select row_id, case when row_number() over (order by date nulls first, row_id) <= floor(0.8 * count(*) over ()) then 'reference' else 'current' end as part from commit_features""")
def win3_chronological_split(s, d):
    return sampling.chronological_split(commits(s, d).select("row_id", "date"), "date", "row_id").select("row_id", "part")


@query("""select commit_hash, row_id, lines_added from (select hash as commit_hash, row_id, lines_added, row_number() over (partition by hash order by ingested_at desc, row_id desc) as k from commit_features where hash is not null) where k = 1""")
def win4_online_store(s, d):
    rows = commits(s, d).select(F.col("hash").alias("commit_hash"), "row_id", "ingested_at", "lines_added")
    return featurestore.online(rows, "commit_hash", "ingested_at", "row_id").select("commit_hash", "row_id", "lines_added")


@query("""select w as window_start, count(*) as events, count(*) / 3600::double as per_second from (
            select time_bucket(interval 15 minutes, ts) - k * interval 15 minutes as w from events, (select unnest([0, 1, 2, 3]) as k)) group by w""")
def win5_sliding_rate(s, d):
    return timeseries.sliding_rate(table(s, d, "events"), "ts", 3600, 900)


@query("select id, repo, created_at from issue order by created_at desc nulls last, id desc limit 50 offset 100")
def srt1_issue_page(s, d):
    """A page of a listing; the limit is the feature."""
    return issues.page(issue(s, d).select("id", "repo", "created_at"), 50, 100)


@query("select row_id, seq from commit_features where date >= timestamp '2022-01-01' order by seq, row_id limit 500")
def srt2_oldest_commits(s, d):
    """The cap on a mined history; the limit is the feature."""
    kept = commits(s, d).filter(F.col("date") >= F.lit("2022-01-01").cast("timestamp_ntz"))
    return kept.select("row_id", "seq").orderBy("seq", "row_id").limit(500)


@query("select row_id, md5(cast(row_id as varchar) || '|42') as place from commit_features")
def srt5_shuffle(s, d):
    return sampling.shuffled(commits(s, d).select("row_id"), "row_id").withColumn("place", sampling.seeded("row_id", 42))


@query("select version, cast(row_number() over (order by cast(version as int)) as int) as place from model_versions")
def srt6_version_order(s, d):
    return metrics.ranked_versions(table(s, d, "model_versions").select("version"), "version")


@query("""select row_id, risky, cast(row_number() over (partition by risky order by md5(cast(row_id as varchar) || '|42'), row_id) <= round(0.2 * count(*) over (partition by risky)) as int) as is_test from commit_features""")
def spl1_stratified_split(s, d):
    return sampling.stratified_split(commits(s, d).select("row_id", "risky"), "row_id", "risky")


@query("""select row_id, risky from (select row_id, risky, row_number() over (partition by risky order by md5(cast(row_id as varchar) || '|42'), row_id) as k,
          floor(400 * avg((risky = 1)::int::double) over ()) as ones from commit_features where risky is not null) where k <= case when risky = 1 then ones else 400 - ones end""")
def spl2_stratified_sample(s, d):
    """The sampling operator; its size is the feature."""
    return sampling.stratified_sample(commits(s, d).select("row_id", "risky"), "row_id", "risky", 400)


@query("""with k as (select source_repo, count(*) as n, sum(risky) as ones, count(*) filter (where risky = is_fix_bug_revert) as hits from commit_features where risky is not null and is_fix_bug_revert is not null group by source_repo)
          select source_repo, n as test_rows, (select sum(n) from k) - n as train_rows, ((select sum(ones) from k) - ones) / ((select sum(n) from k) - n)::double as train_risky_share,
                 ones / n::double as test_risky_share, hits / n::double as test_accuracy from k where source_repo is not null""")
def spl3_leave_one_out(s, d):
    """Each repository held out: sizes, risky shares of both sides, and how well the keyword flag predicts the held-out side. A fold's training side is the whole less the held-out part, so no fold is made as a table."""
    known = predicted(s, d, "source_repo").filter("risky is not null and prediction is not null")
    per = known.groupBy("source_repo").agg(F.count(F.lit(1)).alias("n"), F.sum("risky").alias("ones"), F.count_if(F.col("risky") == F.col("prediction")).alias("hits"))
    all_rows = scalars(known, n=F.count(F.lit(1)), ones=F.sum("risky"))
    rest = all_rows["n"] - F.col("n")
    share = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    return per.filter("source_repo is not null").select("source_repo", F.col("n").alias("test_rows"), rest.alias("train_rows"), share(all_rows["ones"] - F.col("ones"), rest).alias("train_risky_share"), share(F.col("ones"), F.col("n")).alias("test_risky_share"), share(F.col("hits"), F.col("n")).alias("test_accuracy"))


# --- joins, sets, feature store, registry --------------------------------------


@query("""select k.commit_hash, f.lines_added, f.risky from (select distinct commit_hash from issue where commit_hash is not null) k left join (
            select hash, lines_added, risky from (select *, row_number() over (partition by hash order by ingested_at desc, row_id desc) as k from commit_features where hash is not null) where k = 1) f on k.commit_hash = f.hash""")
def jn4_online_lookup(s, d):
    rows = commits(s, d).select(F.col("hash").alias("commit_hash"), "row_id", "ingested_at", "lines_added", "risky")
    store = featurestore.online(rows, "commit_hash", "ingested_at", "row_id")
    return featurestore.lookup(issue(s, d).select("commit_hash").filter("commit_hash is not null").distinct(), store, "commit_hash", ["lines_added", "risky"])


@query("""with e as (select event_id, user_id, ts from events where event_type = 'error'),
          p as (select user_id, ts, value from (select *, row_number() over (partition by user_id, ts order by event_id desc) as k from events where event_type = 'purchase') where k = 1),
          a as (select e.event_id, p.ts as pts, p.value, e.ts from e asof left join p on e.user_id = p.user_id and e.ts >= p.ts)
          select event_id, case when pts >= ts - interval 2 days then pts end as feature_ts, case when pts >= ts - interval 2 days then value end as feature_value from a""")
def jn5_as_of(s, d):
    ev = table(s, d, "events")
    errors = ev.filter("event_type = 'error'").select("event_id", "user_id", "ts")
    bought = ev.filter("event_type = 'purchase'").select("event_id", "user_id", "ts", "value")
    return featurestore.as_of(errors, bought, "user_id", "ts", "event_id", "ts", "event_id", "2 days", ["value"]).select("event_id", "feature_ts", "feature_value")


@query("""select v.version, v.stage, r.f1_again from model_versions v left join (select run_id, f1 * 2 as f1_again from model_versions) r on v.run_id = r.run_id""")
def jn6_version_metrics(s, d):
    v = table(s, d, "model_versions")
    return registry.with_metrics(v, v.select("run_id", (F.col("f1") * 2).alias("f1_again"))).select("version", "stage", "f1_again")


@query("""select row_id from commit_features where hash in (select hash from file_touches)""")
def jn8_semi_join(s, d):
    return commits(s, d).select("row_id", "hash").join(touches(s, d).select("hash"), "hash", "left_semi").select("row_id")


@query("""select distinct a.commit_msg as commit_msg, a.n as n_train, b.n as n_test from (select commit_msg, count(*) as n from commit_features where data_split = 'train' group by 1) a
          join (select commit_msg, count(*) as n from commit_features where data_split = 'test' group by 1) b on a.commit_msg is not distinct from b.commit_msg""")
def set3_content_leakage(s, d):
    df = commits(s, d)
    return quality.content_leakage(df.filter("data_split = 'train'"), df.filter("data_split = 'test'"), ["commit_msg"])


@query("""select distinct hash from commit_features where data_split = 'train' and hash in (select hash from commit_features where data_split = 'test')""")
def dq7_key_leakage(s, d):
    df = commits(s, d)
    return quality.key_leakage(df.filter("data_split = 'train'"), df.filter("data_split = 'test'"), "hash")


@query("select distinct hash from file_touches where hash not in (select hash from commit_features where hash is not null)")
def set4_row_difference(s, d):
    return touches(s, d).select("hash").distinct().join(commits(s, d).select("hash"), "hash", "left_anti")


@query("""select c.version, coalesce(c.f1, 0) as candidate_f1, p.f1 as current_f1, p.f1 is null or coalesce(c.f1, 0) > p.f1 as promote
          from model_versions c left join (select coalesce(f1, 0) as f1 from model_versions where stage = 'Production' order by cast(version as int) desc limit 1) p on true where c.version = '11'""")
def cnd3_promotion(s, d):
    return registry.decide(table(s, d, "model_versions"), "11")


@query("""select version, case when version = '11' then 'Production' when stage = 'Production' then 'Archived' else stage end as stage from model_versions""")
def ml7_promote(s, d):
    return registry.promoted(table(s, d, "model_versions"), "11").select("version", "stage")


@query("select version, run_id, stage, f1 from model_versions order by cast(version as int) desc limit 1")
def ml8_latest_version(s, d):
    return registry.latest(table(s, d, "model_versions"))


# --- data quality ---------------------------------------------------------------


@query("""select 'min_rows' as check_name, 'error' as severity, count(*) >= 100 as passed, count(*)::double as measured from commit_features
          union all select 'target_present', 'error', true, 1.0 union all select 'class_balance', 'warning', avg((risky = 1)::int) >= 0.05, avg((risky = 1)::int) from commit_features
          union all select 'required_columns', 'error', false, 1.0""")
def dq1_table_checks(s, d):
    return quality.table_checks(commits(s, d), [*FEATURES, "risky", "hash", "no_such_column"])


_RANGES = {"hour_of_day": "between 0 and 23", "day_of_week": "between 0 and 6", "is_fix_bug_revert": "between 0 and 1"}


@query("select row_id, array_to_string(list_filter([" + ", ".join(f"case when not coalesce({c} {_RANGES.get(c, '>= 0')}, false) then '{c}' end" for c in FEATURES) + "], lambda x: x is not null), ',') as violations from commit_features")
def dq5_request_ranges(s, d):
    return quality.request_violations(commits(s, d)).select("row_id", F.array_join("violations", ",").alias("violations"))


@query("""select id, array_to_string(list_filter([case when not coalesce(gate in (1, 2, 3), false) then 'gate' end, case when not coalesce(length(type) between 1 and 50, false) then 'type' end,
          case when not coalesce(length(repo) between 1 and 255, false) then 'repo' end, case when not coalesce(length(status) <= 20, false) then 'status' end,
          case when not coalesce(commit_hash is null or length(commit_hash) <= 40, false) then 'commit_hash' end], lambda x: x is not null), ',') as violations from issue""")
def dq6_issue_validity(s, d):
    return issues.checked(issue(s, d)).select("id", F.array_join("violations", ",").alias("violations"))


def _drift(s, d):
    parted = sampling.chronological_split(commits(s, d).select("row_id", "date", *FEATURES), "date", "row_id")
    parted = materialise(parted, "parts")
    return quality.drift(parted.filter("part = 'reference'"), parted.filter("part = 'current'"), list(FEATURES))


_KS = """(with p as (select *, row_number() over (order by date nulls first, row_id) <= floor(0.8 * count(*) over ()) as ref from commit_features),
    l as (""" + " union all ".join(f"select '{c}' as column_name, {c}::double as v, ref from p" for c in FEATURES) + """),
    c as (select column_name, v, count(*) filter (where ref) as r, count(*) filter (where not ref) as c from l where v is not null group by all),
    k as (select column_name, sum(r) over w / (sum(r) over q)::double as fr, sum(c) over w / (sum(c) over q)::double as fc, sum(r) over q as n_reference, sum(c) over q as n_current from c
          window w as (partition by column_name order by v), q as (partition by column_name))
    select column_name, cast(max(n_reference) as bigint) as n_reference, cast(max(n_current) as bigint) as n_current, max(abs(fr - fc)) as statistic from k group by column_name)"""


@query(f"select column_name, n_reference, n_current, statistic from {_KS}")
def dq8_drift_statistic(s, d):
    return _drift(s, d).select("column_name", "n_reference", "n_current", "statistic")


@query(f"""select count(*) as columns, count(*) filter (where p < 0.05) as drifted, count(*) filter (where p < 0.05) / count(*)::double as share from (
           select case when l < 0.2 then 1.0 else greatest(least(list_sum(list_transform(range(1, 21), lambda k: 2.0 * (case when k % 2 = 1 then 1 else -1 end) * exp(-2.0 * k * k * l * l))), 1.0), 0.0) end as p
           from (select (e + 0.12 + 0.11 / e) * statistic as l from (select statistic, sqrt(n_reference * n_current / (n_reference + n_current)::double) as e from {_KS})))""")
def dq8_drift_report(s, d):
    return quality.drift_share(_drift(s, d))


@query("select event_id, value from events where value > 100")
def dq11_slow_requests(s, d):
    return table(s, d, "events").filter("value > 100").select("event_id", "value")


@query("select request_id, array_to_string(list_filter([case when score is null or score not between 0 and 1 then 'risk_score' end, case when label is null or label not in ('low', 'medium', 'high') then 'risk_label' end], lambda x: x is not null), ',') as violations from (select id as request_id, risk_score / 50::double as score, case when risk_score < 30 then 'low' when risk_score < 60 then 'medium' else 'odd' end as label from issue)")
def dq9_response_schema(s, d):
    df = issue(s, d).select(F.col("id").alias("request_id"), (F.col("risk_score") / 50).cast("double").alias("risk_score"), F.when(F.col("risk_score") < 30, "low").when(F.col("risk_score") < 60, "medium").otherwise("odd").alias("risk_label"))
    return quality.response_violations(df).select("request_id", F.array_join("violations", ",").alias("violations"))


@query()
def dq10_sanity_order(s, d):
    """Whether a large, late change scores above a small one of a known author."""
    from riskloom.schemas import REQUEST

    train, _ = _parts(s, d)
    rows = s.createDataFrame([(5, 2, 1, 1, 500, 14, 1, 25, 0), (500, 300, 25, 10, 0, 2, 6, 150, 1)], REQUEST)
    got = models.scored(models.fit(train, "forest"), rows)
    return got.agg(F.min_by("risk_score", "lines_added").alias("safe"), F.max_by("risk_score", "lines_added").alias("risky")).withColumn("ordered", F.col("risky") > F.col("safe"))


@query("""select row_id, lines_added, (lines_added - avg(lines_added) filter (where data_split = 'train') over ()) / nullif(stddev_samp(lines_added) filter (where data_split = 'train') over (), 0) as scaled
          from commit_features where lines_added is not null""")
def mth5_standardised(s, d):
    """Mean 0 and sample deviation 1 of the training rows, applied to all; the two numbers are one row."""
    df = commits(s, d).select("row_id", "lines_added", "data_split").filter("lines_added is not null")
    m = scalars(df.filter("data_split = 'train'"), mean=F.avg("lines_added"), sd=F.stddev_samp("lines_added"))
    return df.select("row_id", "lines_added", F.try_divide(F.col("lines_added") - m["mean"], m["sd"]).alias("scaled"))


@query("select source_repo, coalesce(sum(risky)::double / nullif(sum(case when risky is null then 0 else lines_deleted end), 0), 0) as ratio from commit_features group by source_repo")
def mth4_guarded_division(s, d):
    known = F.when(F.col("risky").isNull(), 0).otherwise(F.col("lines_deleted"))
    return commits(s, d).groupBy("source_repo").agg(C.ratio_or_zero(F.sum("risky"), F.sum(known)).alias("ratio"))


@query("select row_id from commit_features where risky = 1")
def flt3_class_filter(s, d):
    return commits(s, d).filter("risky = 1").select("row_id")


@query("select version, f1 from model_versions where stage = 'Production'")
def flt8_stage_filter(s, d):
    return table(s, d, "model_versions").filter("stage = 'Production'").select("version", "f1")


@query("select row_id from commit_features where source_repo = 'tinworks/quillgate'")
def flt9_repo_subset(s, d):
    return commits(s, d).filter("source_repo = 'tinworks/quillgate'").select("row_id")


@query("select hash from (select distinct hash from commit_features where hash is not null) order by hash limit 5")
def srt3_sample_keys(s, d):
    """Five keys for a demonstration; the limit is the feature."""
    return commits(s, d).select("hash").filter("hash is not null").distinct().orderBy("hash").limit(5)


@query("select hash from (select distinct hash from commit_features where data_split = 'train' and hash in (select hash from commit_features where data_split = 'test')) order by hash limit 10")
def srt7_leaked_keys_message(s, d):
    """The first ten leaked keys of a message; the limit is the feature."""
    df = commits(s, d)
    return quality.key_leakage(df.filter("data_split = 'train'"), df.filter("data_split = 'test'"), "hash").orderBy("hash").limit(10)


@query("select id, created_at - interval 730 days as earlier, strftime(created_at, '%b %-d, %Y %H:%M') as shown, coalesce(strftime(nullif(updated_at, created_at), '%b %-d'), '-') as axis from issue")
def dt7_shifted_and_shown(s, d):
    back = F.col("created_at") - F.expr("interval 730 days")
    axis = F.coalesce(F.date_format(F.nullif("updated_at", "created_at"), "MMM d"), F.lit("-"))
    return issue(s, d).select("id", back.alias("earlier"), F.date_format("created_at", "MMM d, yyyy HH:mm").alias("shown"), axis.alias("axis"))


@query("select i.id, c.row_id from issue i join commit_features c on i.commit_hash = c.hash")
def jn3_key_lookup(s, d):
    return issue(s, d).select("id", "commit_hash").join(commits(s, d).select("row_id", "hash"), F.col("commit_hash") == F.col("hash")).select("id", "row_id")


# --- models ----------------------------------------------------------------------


def _parts(s, d):
    df = sampling.stratified_split(commits(s, d).select("row_id", "risky", *FEATURES).filter("risky is not null"), "row_id", "risky")
    df = materialise(df, "split")
    return df.filter("is_test = 0"), df.filter("is_test = 1")


@query()
def ml6_compare(s, d):
    """Logistic, forest and boosted classifiers on one split, best first."""
    train, test = _parts(s, d)
    return models.compare(train, test, ["boosted", "forest", "logistic"]).orderBy(F.desc("f1"), "ord")


@query()
def ml5_score(s, d):
    """Scores of all rows by a classifier fitted on the training part."""
    train, _ = _parts(s, d)
    return models.scored(models.fit(train, "logistic"), commits(s, d).select("row_id", *FEATURES)).select("row_id", "risk_score", "predicted", "risk_label")


@query()
def ml4_network(s, d):
    train, test = _parts(s, d)
    return models.compare(train, test, ["network"])


@query()
def agg19_importance(s, d):
    train, _ = _parts(s, d)
    return models.importance(s, models.fit(train, "forest"))


# --- streaming ---------------------------------------------------------------------


@query("""select w as window_start, event_type, count(*) as events from (select time_bucket(interval 1 hour, ts) - k * interval 1 hour as w, event_type from events, (select unnest([0, 1]) as k)) group by all""")
def str_sliding_counts(s, d):
    out = streams.run_once(streams.sliding_counts(streams.source(s, d, "events"), "ts", "1 hour", "2 hours", "1 hour", "event_type"), "complete")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("select type, status, count(*) as issues from issue group by type, status")
def str_issue_counts(s, d):
    return streams.run_once(streams.status_counts(streams.source(s, d, "issue")), "complete")


@query(f"select hash from {_AGAIN}")
def str_incremental_label(s, d):
    """The re-touch label from a stateful stream; the files are one batch, so the result equals the batch query."""
    return streams.retouched_once(streams.source(s, d, "file_touches")).distinct()
