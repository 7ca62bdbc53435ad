"""Timestamps in mixed notations and zones to one UTC instant.

A text is reduced to its shape: digits become 9, runs of letters a. Each
distinct shape is mapped to a parser once per Python worker; the matched fields
of a batch are converted as arrays, and wall times go through tables of zone
transitions, which carry the version of the zone data they were made from.

Defined results: null, blank or unreadable text gives null; so do dates that do
not exist, wall times that a clock change skips or, with nothing to tell which,
repeats, and an order of day and month that neither the digits nor the weekday
settle. Missing parts count as 0; digits beyond microseconds are cut off.
"""

from __future__ import annotations

import functools
import re
import zoneinfo
from datetime import datetime, timedelta, timezone
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SECOND = 1_000_000
DAY = 86_400 * SECOND
#: Shapes that a worker remembers; beyond it, it starts to learn them again.
MOST_SHAPES = 50_000

# English month names and weekday names as dates are written.
MONTHS = {m: i + 1 for i, names in enumerate(("jan january", "feb february", "mar march", "apr april", "may may", "jun june", "jul july", "aug august", "sep september sept", "oct october", "nov november", "dec december")) for m in names.split()}
WEEKDAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")

_CLOCK = r"(?P<h>\d{1,2}):(?P<mi>\d\d)(?::(?P<s>\d\d)(?:[.,](?P<f>\d+))?)?"
_ZONE = r"(?P<z>\s*[^\d\s].*)?"
_WEEKDAY = r"(?:[A-Za-z]{3,9},?\s+)?"
#: Notations; no text fits two of them.
GRAMMARS = {
    name: re.compile(pattern)
    for name, pattern in {
        "ymd": rf"(?P<y>\d{{4}})[-/.](?P<mo>\d\d?)[-/.](?P<d>\d\d?)(?:(?:[Tt]|\s+){_CLOCK}{_ZONE})?",
        "compact": rf"(?P<y>\d{{4}})(?P<mo>\d\d)(?P<d>\d\d)[Tt](?P<h>\d\d)(?P<mi>\d\d)(?:(?P<s>\d\d)(?:[.,](?P<f>\d+))?)?{_ZONE}",
        "ordinal": rf"(?P<y>\d{{4}})-(?P<doy>\d{{3}})(?:[Tt]|\s+){_CLOCK}{_ZONE}",
        "week": rf"(?P<y>\d{{4}})-[Ww](?P<wk>\d\d)-(?P<wd>\d)(?:[Tt]|\s+){_CLOCK}{_ZONE}",
        "mail": rf"{_WEEKDAY}(?P<d>\d\d?)[\s-](?P<mon>[A-Za-z]{{3,9}})\.?[\s-](?P<y>\d{{4}}|\d\d)\s+{_CLOCK}{_ZONE}",
        "ctime": rf"[A-Za-z]{{3,9}},?\s+(?P<mon>[A-Za-z]{{3,9}})\s+(?P<d>\d\d?)\s+{_CLOCK}\s+(?P<y>\d{{4}}){_ZONE}",
        "us_words": rf"{_WEEKDAY}(?P<mon>[A-Za-z]{{3,9}})\.?\s+(?P<d>\d\d?),\s*(?P<y>\d{{4}})\s+{_CLOCK}(?:\s*(?P<ap>[AaPp]\.?[Mm]\.?))?{_ZONE}",
        "slashes": rf"(?P<a>\d\d?)/(?P<b>\d\d?)/(?P<y>\d{{4}})\s+{_CLOCK}{_ZONE}",
        "dots": rf"(?P<d>\d\d?)\.(?P<mo>\d\d?)\.(?P<y>\d{{4}})\s+{_CLOCK}{_ZONE}",
        "epoch": r"@?(?P<e>-?\d{1,20})(?:[.,](?P<f>\d+))?(?:\s*[+-]\d\d:?\d\d)?",
    }.items()
}
_OFFSET = re.compile(r"(?:(?:UTC|GMT)\s*)?([+-])(\d\d):?(\d\d)?(?::?(\d\d))?(?:\s*\[([A-Za-z_]+(?:/[A-Za-z0-9_+-]+)*)\])?", re.I)
_NAMED = re.compile(r"\[?([A-Za-z_]+(?:/[A-Za-z0-9_+-]+)+)\]?")
_TABLE = str.maketrans(dict.fromkeys("−‐‑–－", "-") | dict.fromkeys("   　", " ") | {"＋": "+", "：": ":", "／": "/"} | {chr(0xFF10 + i): str(i) for i in range(10)} | dict.fromkeys("​﻿"))
_MASK = str.maketrans("012345678", "9" * 9)
_WORD = re.compile(r"[^\W\d_]+")


def shape_mask(text: str) -> str:
    """The class of characters at each place: 9 for digits, a for a run of letters."""
    return _WORD.sub("a", text.translate(_MASK))


@functools.cache
def zone_version() -> str:
    """Version of the zone data in use, for results that have to be made again later."""
    for root in zoneinfo.TZPATH:
        for name, start in (("+VERSION", ""), ("tzdata.zi", "# version ")):
            p = Path(root, name)
            if p.exists():
                return p.open().readline().strip().removeprefix(start)
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        return "unknown"


@functools.cache
def zone_table(name: str, version: str) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """UTC microseconds of the transitions from 1900 to 2150, and the offset and abbreviation before, between and after them."""
    try:
        zone = zoneinfo.ZoneInfo(name)
    except Exception:
        return None
    epoch = datetime(1970, 1, 1, tzinfo=timezone.utc)

    def state(at: int) -> tuple[int, str]:
        local = (epoch + timedelta(seconds=at)).astimezone(zone)
        return round(local.utcoffset().total_seconds()), local.tzname() or ""

    step, lo, end = 14 * 86_400, -2_208_988_800, 5_680_281_600
    last = state(lo)
    cuts, states = [], [last]
    while lo < end:
        hi = lo + step
        now = state(hi)
        while now != last:  # one or more changes lie in (lo, hi]
            a, b = lo, hi
            while b - a > 1:
                m = (a + b) // 2
                a, b = (m, b) if state(m) == last else (a, m)
            last = state(b)
            cuts.append(b)
            states.append(last)
            lo = b
        lo = hi
    return np.array(cuts, dtype=np.int64) * SECOND, np.array([s[0] for s in states], dtype=np.int64) * SECOND, np.array([s[1] for s in states], dtype=object)


@functools.lru_cache(maxsize=65_536)
def read_zone(text: str) -> tuple[str, object]:
    """What stands behind a wall time: an offset in microseconds, a zone name, an abbreviation, nothing, or what can't be read."""
    t = text.strip()
    if not t:
        return "none", None
    if t.upper() in ("Z", "UTC", "GMT", "UT"):
        return "offset", 0
    if m := _OFFSET.fullmatch(t):
        h, mi, s = int(m[2]), int(m[3] or 0), int(m[4] or 0)
        if h > 15 or mi > 59 or s > 59:
            return "bad", None
        return "offset", (1 if m[1] == "+" else -1) * (h * 3600 + mi * 60 + s) * SECOND
    if m := _NAMED.fullmatch(t):
        return "zone", m[1]
    if re.fullmatch(r"[A-Za-z]{2,5}", t):
        return "abbreviation", t.upper()
    return "bad", None


def days_of(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Days since 1970 and whether the date exists."""
    ok = (m >= 1) & (m <= 12) & (d >= 1) & (y >= 1)
    first = (np.where(ok, y, 1970) - 1970).astype("datetime64[Y]").astype("datetime64[M]") + (np.where(ok, m, 1) - 1)
    start = first.astype("datetime64[D]").astype(np.int64)
    length = (first + 1).astype("datetime64[D]").astype(np.int64) - start
    return start + d - 1, ok & (d <= length)


def local_to_utc(wall: np.ndarray, zone: str, abbreviation: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """UTC of wall times in a zone, and whether each is exactly one instant."""
    table = zone_table(zone, zone_version())
    if table is None:
        return wall, np.zeros(len(wall), dtype=bool)
    cuts, offsets, names = table
    low, high = np.searchsorted(cuts, wall - DAY, "right"), np.searchsorted(cuts, wall + DAY, "right")
    utc, hits = wall.copy(), np.zeros(len(wall), dtype=np.int64)
    for k in range(int((high - low).max(initial=0)) + 1):
        at = np.minimum(low + k, high)
        u = wall - offsets[at]
        fits = (np.searchsorted(cuts, u, "right") == at) & (low + k <= high)
        if abbreviation is not None:
            fits &= names[at] == abbreviation
        new = fits & ((hits == 0) | (utc != u))
        utc, hits = np.where(new, u, utc), hits + new
    return utc, hits == 1


def offset_at(utc: np.ndarray, zone: str) -> np.ndarray | None:
    """Microseconds between UTC and the wall clock of a zone at given instants."""
    table = zone_table(zone, zone_version())
    return None if table is None else table[1][np.searchsorted(table[0], utc, "right")]


class InstantReader:
    """Reads batches; keeps the parser of each shape it has met."""

    def __init__(self) -> None:
        self.parsers: dict[str, tuple[str, ...]] = {}

    def match(self, text: str) -> tuple[str, re.Match] | None:
        mask = shape_mask(text)
        if len(self.parsers) > MOST_SHAPES:
            self.parsers.clear()
        known = self.parsers.get(mask, ())
        for name in known:
            if m := GRAMMARS[name].fullmatch(text):
                return name, m
        if mask in self.parsers and not any(c == "a" for c in mask):
            return None  # a shape without words has one parser or none
        for name, rx in GRAMMARS.items():
            if name not in known and (m := rx.fullmatch(text)):
                self.parsers[mask] = (*known, name)
                return name, m
        self.parsers.setdefault(mask, ())
        return None

    def read(self, texts: pd.Series, zones: pd.Series, weekdays: pd.Series) -> pd.DataFrame:
        n = len(texts)
        groups: dict[str, list[tuple[int, re.Match]]] = {}
        for i, t in enumerate(texts):
            if isinstance(t, str) and (t := t.translate(_TABLE).strip()) and (got := self.match(t)):
                groups.setdefault(got[0], []).append((i, got[1]))
        zone_of = [z.strip() if isinstance(z, str) and z.strip() else None for z in zones]
        week = pd.to_numeric(weekdays, errors="coerce").to_numpy(dtype=float, na_value=np.nan)
        utc, ok = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
        wall, has_wall = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
        need: dict[tuple[str, bool], list[tuple[int, str | None]]] = {}
        for name, found in groups.items():
            at = np.array([i for i, _ in found])
            fields = {k: [m.group(k) for _, m in found] for k in GRAMMARS[name].groupindex}
            micro = np.array([int((x or "")[:6].ljust(6, "0")) for x in fields["f"]]) if "f" in fields else np.zeros(len(at), dtype=np.int64)
            if name == "epoch":
                scale = [10 ** max(0, 3 * ((len(e.lstrip("-")) - 9) // 3)) for e in fields["e"]]  # up to 11 digits are seconds, 12 to 14 milliseconds
                value = [_epoch(e, f or "", s) for e, f, s in zip(fields["e"], fields["f"], scale)]
                fits = np.array([abs(v) < 2**62 for v in value])
                utc[at], ok[at] = np.where(fits, [v if abs(v) < 2**62 else 0 for v in value], 0), fits
                continue
            num = lambda k: np.array([int(x or 0) for x in fields[k]], dtype=np.int64) if k in fields else np.zeros(len(at), dtype=np.int64)
            y = num("y")
            y = np.where((y < 100) & np.array([len(x) == 2 for x in fields["y"]]), np.where(y < 69, y + 2000, y + 1900), y)
            if name == "ordinal":
                start, good = days_of(y, np.ones_like(y), np.ones_like(y))
                until, _ = days_of(y + 1, np.ones_like(y), np.ones_like(y))
                days, good = start + num("doy") - 1, good & (num("doy") >= 1) & (num("doy") <= until - start)
            elif name == "week":
                one, four = np.ones_like(y), np.full_like(y, 4)
                monday = lambda yy: (d4 := days_of(yy, one, four)[0]) - (d4 + 3) % 7
                start = monday(y)
                days = start + (num("wk") - 1) * 7 + num("wd") - 1
                good = (num("wk") >= 1) & (num("wd") >= 1) & (num("wd") <= 7) & (start + (num("wk") - 1) * 7 < monday(y + 1))
            elif name == "slashes":
                a, b = num("a"), num("b")
                (first, f_ok), (second, s_ok) = days_of(y, b, a), days_of(y, a, b)
                both = f_ok & s_ok & (first != second)
                w = week[at]
                f_hit, s_hit = both & ((first + 3) % 7 == w), both & ((second + 3) % 7 == w)
                days = np.where(both, np.where(f_hit, first, second), np.where(f_ok, first, second))
                good = np.where(both, f_hit ^ s_hit, f_ok | s_ok)
            else:
                mo = np.array([MONTHS.get(x.lower(), 0) for x in fields["mon"]]) if "mon" in fields else num("mo")
                days, good = days_of(y, mo, num("d"))
            h = num("h")
            if "ap" in fields:
                half = [(x or "")[:1].lower() for x in fields["ap"]]
                is_half, pm = np.array([x != "" for x in half]), np.array([x == "p" for x in half])
                good &= ~is_half | ((h >= 1) & (h <= 12))
                h = np.where(is_half, h % 12 + 12 * pm, h)
            good &= (h < 24) & (num("mi") < 60) & (num("s") < 60)
            local = days * DAY + (h * 3600 + num("mi") * 60 + num("s")) * SECOND + micro
            wall[at], has_wall[at] = local, good
            for i, z, fine in zip(at, fields["z"] if "z" in fields else [None] * len(at), good):
                if not fine:
                    continue
                kind, value = read_zone(z or "")
                if kind == "offset":
                    utc[i], ok[i] = wall[i] - value, True
                elif kind == "zone":
                    need.setdefault((value, False), []).append((i, None))
                elif kind == "none" and zone_of[i]:
                    need.setdefault((zone_of[i], False), []).append((i, None))
                elif kind == "abbreviation" and zone_of[i]:
                    need.setdefault((zone_of[i], True), []).append((i, value))
        for (zone, short), rows in need.items():
            at = np.array([i for i, _ in rows])
            utc[at], ok[at] = local_to_utc(wall[at], zone, np.array([a for _, a in rows], dtype=object) if short else None)
        shown = np.where(has_wall, wall, utc)  # the wall clock written, unless the author's zone is known
        code, names = pd.factorize(np.array([z if fine else None for z, fine in zip(zone_of, ok)], dtype=object))
        order = np.argsort(code, kind="stable")
        for zone, at in zip(names, np.split(order, np.searchsorted(code[order], np.arange(len(names))))[1:]):
            if (off := offset_at(utc[at], zone)) is not None:
                shown[at] = utc[at] + off
        gone = ~ok
        ints = lambda x, kind: pd.array(x, dtype=kind)
        out = pd.DataFrame({"epoch_us": ints(utc, "Int64"), "hour_of_day": ints((shown // (3600 * SECOND)) % 24, "Int32"), "day_of_week": ints((shown // DAY + 3) % 7, "Int32")})
        out[gone] = pd.NA
        return out


def _epoch(whole: str, part: str, scale: int) -> int:
    """Microseconds of a number of seconds, milliseconds, microseconds or nanoseconds, cut off without rounding."""
    digits = part[:9].ljust(9, "0")
    nano = int(whole.lstrip("-") + digits) // scale  # units of a thousand-millionth of a second
    return (-1 if whole.startswith("-") else 1) * (nano // 1000)


_READER = InstantReader()


_INSTANT = T.StructType([T.StructField("epoch_us", T.LongType()), T.StructField("hour_of_day", T.IntegerType()), T.StructField("day_of_week", T.IntegerType())])


@F.pandas_udf(_INSTANT)
def _read(texts: pd.Series, zones: pd.Series, weekdays: pd.Series) -> pd.DataFrame:
    return _READER.read(texts, zones, weekdays)


def instant_of(text: Column, zone: Column, weekday: Column) -> Column:
    """struct(epoch_us, hour_of_day, day_of_week); its fields are null where the record does not settle the instant."""
    return _read(text.cast("string"), zone.cast("string"), weekday.cast("double"))


def normalise_instants(df: DataFrame, text: str, zone: str, weekday: str, prefix: str = "utc_") -> DataFrame:
    """`df` (its columns of these names replaced) with utc_epoch_us, utc_instant (timestamp without zone, UTC), utc_hour_of_day and utc_day_of_week of the author's wall clock."""
    got = df.withColumn("__instant", instant_of(F.col(text), F.col(zone), F.col(weekday)))
    us = F.col("__instant.epoch_us")
    instant = F.timestamp_micros(us).cast("timestamp_ntz")
    kept = [c for c in df.columns if c not in {prefix + x for x in ("epoch_us", "instant", "hour_of_day", "day_of_week")}]
    return got.select(*kept, us.alias(f"{prefix}epoch_us"), instant.alias(f"{prefix}instant"), F.col("__instant.hour_of_day").alias(f"{prefix}hour_of_day"), F.col("__instant.day_of_week").alias(f"{prefix}day_of_week"))
