"""Column functions: text, time, numbers, conditions. All are built-in expressions, so they stay in generated code.

A null input gives null unless the docstring says otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """Whether the text holds any of the words as a substring, in any case; false for null."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(w.lower())) for w in words])


def text_length(text: Column) -> Column:
    """Code points; 0 for null."""
    return F.length(F.coalesce(text, F.lit("")))


def dirname(path: Column) -> Column:
    """The part before the last slash, empty if there is none."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def first_filled(*columns: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def repo_name(url: Column) -> Column:
    """The last segment of a URL without `.git`."""
    return F.replace(F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1), F.lit(".git"), F.lit(""))


def split_list(text: Column) -> Column:
    """Entries of a comma-separated list, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def first_match(text: Column, cases: Sequence[tuple[str, str]], default: str) -> Column:
    """The value of the first pattern, in order, that the text holds as a substring."""
    out = F.lit(default)
    for part, value in reversed(cases):
        out = F.when(F.contains(text, F.lit(part)), F.lit(value)).otherwise(out)
    return out


def whole_days(start: Column, end: Column) -> Column:
    """Whole periods of 24 hours between two instants, rounded down; not calendar days."""
    us = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return F.floor(us / F.lit(86_400_000_000)).cast("bigint")


def within_days(start: Column, end: Column, days: int) -> Column:
    """whole_days(start, end) <= days, as one comparison; false if either is null."""
    return F.coalesce(end < start + F.expr(f"interval {days + 1} days"), F.lit(False))


def wall_time(instant: Column, offset_s: Column) -> Column:
    """The wall clock at a distance of `offset_s` seconds from UTC."""
    return F.timestamp_seconds(F.unix_micros(instant.cast("timestamp")) / 1_000_000 + offset_s).cast("timestamp_ntz")


def monday_weekday(moment: Column) -> Column:
    """0 for Monday to 6 for Sunday."""
    return F.weekday(moment)


def parse_day(text: Column) -> Column:
    """A strict yyyy-MM-dd text as a timestamp; null if it is none."""
    return F.when(F.length(text) == 10, F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))).cast("timestamp_ntz")


def bucket(value: Column, bounds: Sequence[tuple[float, str, bool]], above: str) -> Column:
    """The label of the first bound that the value is under (or at, where the flag says so)."""
    out = F.lit(above)
    for limit, label, closed in reversed(bounds):
        out = F.when(value <= limit if closed else value < limit, F.lit(label)).otherwise(out)
    return F.when(value.isNotNull(), out)


#: Score levels: under 0.3 low, up to 0.6 medium, above it high.
LEVELS = ((0.3, "low", False), (0.6, "medium", True))


def risk_level(score: Column) -> Column:
    return bucket(score, LEVELS, "high")


def percent(score: Column) -> Column:
    """Hundredths as an integer, cut off."""
    return (score * 100).cast("int")


def ratio_or_zero(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0 or either is null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def first_labels(rules: Sequence[tuple[Column, Column]], most: int, default: str) -> Column:
    """The labels of the first `most` rules that hold, in order; the default if none does."""
    held = F.filter(F.array(*[F.when(c, t) for c, t in rules]), lambda x: x.isNotNull())
    return F.when(F.size(held) > 0, F.slice(held, 1, most)).otherwise(F.array(F.lit(default)))


# Limits and wording of what is notable in a change.
_FILES, _LINES, _DIRECTORIES, _KNOWN_AUTHOR = 5, 100, 5, 5
_NIGHT_ENDS, _NIGHT_BEGINS, _MORNING_ENDS = 6, 22, 8
_NOTHING_NOTABLE = "no notable risk factors"


def notable_factors(most: int = 3) -> Column:
    """The first `most` notable things of a feature row, in the order of importance; a missing feature counts as unremarkable."""
    number = lambda c, default: F.coalesce(F.col(c), F.lit(default))
    files, dirs, hour, prior = number("files_touched", 0), number("dirs_touched", 0), number("hour_of_day", 12), number("author_prior_commits", 0)
    lines = number("lines_added", 0) + number("lines_deleted", 0)
    rules = [
        (files > _FILES, F.format_string("%d files touched", files)),
        (lines > _LINES, F.format_string("%d lines changed", lines)),
        ((hour < _NIGHT_ENDS) | (hour > _NIGHT_BEGINS), F.format_string("changed at %d:00 (late night/early morning)", hour)),
        (hour.between(_NIGHT_ENDS, _MORNING_ENDS - 1), F.format_string("changed at %d:00 (early morning)", hour)),
        (prior == 0, F.lit("first-time contributor")),
        (prior.between(1, _KNOWN_AUTHOR - 1), F.format_string("new contributor (%d prior commits)", prior)),
        (number("is_fix_bug_revert", 0) == 1, F.lit("commit message contains fix/bug/revert keywords")),
        (dirs > _DIRECTORIES, F.format_string("spans %d directories", dirs)),
    ]
    return first_labels(rules, most, _NOTHING_NOTABLE)


def lookup(key: Column, table: dict[str, str], default: str) -> Column:
    """The entry of a fixed map."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def violations(rules: dict[str, Column]) -> Column:
    """Names of the rules that do not hold; a rule that is null does not hold."""
    return F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
