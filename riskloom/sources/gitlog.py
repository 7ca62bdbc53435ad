"""Git histories as a Spark source: `spark.read.format("git_commits").option("path", ...)`.

The driver lists commit hashes only; tasks read the commits of their slice with
one `git log` each. The working copy has to be visible to the executors. Options:
path, since (a date), until, slice (commits per task, default 2000). Rows follow
`schemas.COMMIT`; `seq` is the place in the listing, oldest first. Merge commits
have no files of their own. Undecodable bytes are replaced.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from riskloom.schemas import COMMIT

_RECORD, _FIELD = "\x1e", "\x1f"
_FORMAT = _RECORD + _FIELD.join(("%H", "%an", "%aI", "%B")) + _FIELD


def git(path: str, *args: str, timeout: int = 600, given: str | None = None) -> str:
    """The output of a git command; raises RuntimeError with git's message."""
    done = subprocess.run(["git", "-c", "safe.directory=*", "-C", path, *args], input=given, capture_output=True, text=True, errors="replace", timeout=timeout)
    if done.returncode:
        raise RuntimeError(f"git {args[0]}: {done.stderr.strip()[:500]}")
    return done.stdout


def open_repository(source: str, cache: str, timeout: int = 600) -> str:
    """The path of a working copy: a local one as it is, a known clone brought up to date, or a new clone."""
    if Path(source).exists():
        return source
    at = Path(cache) / source.rstrip("/").split("/")[-1].replace(".git", "")
    if at.exists():
        git(str(at), "pull", "--quiet", timeout=timeout)
    else:
        at.parent.mkdir(parents=True, exist_ok=True)
        git(str(at.parent), "clone", "--quiet", source, at.name, timeout=timeout)
    return str(at)


def renamed(path: str) -> tuple[str, str | None]:
    """New and old path of a numstat entry such as `a/{b => c}/d` or `a => b`."""
    if " => " not in path:
        return path, None
    if "{" in path and "}" in path:
        head, _, rest = path.partition("{")
        middle, _, tail = rest.partition("}")
        old, _, new = middle.partition(" => ")
        return (head + new + tail).replace("//", "/"), (head + old + tail).replace("//", "/")
    old, _, new = path.partition(" => ")
    return new, old


class Slice(InputPartition):
    def __init__(self, first: int, hashes: list[str]) -> None:
        self.first, self.hashes = first, hashes


class Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.repo = options.get("repo") or Path(self.path).resolve().name
        self.since, self.until, self.slice = options.get("since"), options.get("until"), int(options.get("slice", 2000))

    def partitions(self) -> list[Slice]:
        limits = [f"--since={self.since}"] * bool(self.since) + [f"--until={self.until}"] * bool(self.until)
        hashes = git(self.path, "rev-list", "--reverse", *limits, "HEAD").split()
        return [Slice(i, hashes[i : i + self.slice]) for i in range(0, len(hashes), self.slice)] or [Slice(0, [])]

    def read(self, partition: Slice) -> Iterator[tuple]:
        if not partition.hashes:
            return
        text = git(self.path, "log", "--no-walk=unsorted", "--stdin", "--numstat", f"--format={_FORMAT}", given="\n".join(partition.hashes))
        for place, record in enumerate(text.split(_RECORD)[1:]):
            h, author, date, msg, stat = record.split(_FIELD)
            when = datetime.fromisoformat(date)
            files, added, deleted = [], 0, 0
            for line in stat.strip().splitlines():
                a, d, path = line.split("\t", 2)
                added, deleted = added + (int(a) if a.isdigit() else 0), deleted + (int(d) if d.isdigit() else 0)
                new, old = renamed(path)
                files.append((new, old))
            yield (h, self.repo, author, when.astimezone(timezone.utc), int(when.utcoffset().total_seconds()), partition.first + place, added, deleted, len(files), files, msg.strip("\n"))


class GitCommits(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_commits"

    def schema(self) -> StructType:
        return COMMIT

    def reader(self, schema: StructType) -> Reader:
        return Reader(dict(self.options))


def commits(spark: SparkSession, path: str, **options: str):
    """The commits of a working copy."""
    spark.dataSource.register(GitCommits)
    return spark.read.format("git_commits").options(path=path, **options).load()
