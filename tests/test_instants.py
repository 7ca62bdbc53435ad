from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from riskloom.operators import instants
from riskloom.operators.instants import InstantReader, normalise_instants, shape_mask, zone_table, zone_version


def us(y, m, d, h=0, mi=0, s=0, f=0):
    return int(datetime(y, m, d, h, mi, s, tzinfo=timezone.utc).timestamp()) * 1_000_000 + f


def read(text, zone=None, weekday=None):
    r = InstantReader().read(pd.Series([text], dtype=object), pd.Series([zone], dtype=object), pd.Series([weekday]))
    v = r["epoch_us"][0]
    return None if pd.isna(v) else int(v)


@pytest.mark.parametrize("text, zone, weekday, want", [
    ("2021-01-10T16:52:16+11:00", None, None, us(2021, 1, 10, 5, 52, 16)),
    ("Mon, 04 Jan 2021 09:49:50 +0545", "Europe/Berlin", None, us(2021, 1, 4, 4, 4, 50)),
    ("Sun Jan 10 00:20:37 2021 +0900", None, None, us(2021, 1, 9, 15, 20, 37)),
    ("2021-01-04 16:04:29", "Europe/Berlin", None, us(2021, 1, 4, 15, 4, 29)),
    ("2021-01-04 16:04:29", None, None, None),
    ("1609862370 +0900", "Europe/Lisbon", None, 1609862370_000000),
    ("@1610075994", None, None, 1610075994_000000),
    ("1609775893.1956789", None, None, 1609775893_195678),
    ("1610420845185", None, None, 1610420845_185000),
    ("1609989606367266", None, None, 1609989606_367266),
    ("07-Jan-21 09:32:56", "Etc/UTC", None, us(2021, 1, 7, 9, 32, 56)),
    ("Jan 11, 2021 12:42 am", "Etc/UTC", None, us(2021, 1, 11, 0, 42)),
    ("Jan 12, 2021 3:24 p.m.", "Etc/UTC", None, us(2021, 1, 12, 15, 24)),
    ("2021-011T18:31:13+09:00", None, None, us(2021, 1, 11, 9, 31, 13)),
    ("2021-W01-5T01:29:15+01:00", None, None, us(2021, 1, 8, 0, 29, 15)),
    ("20210115T191006+0100", None, None, us(2021, 1, 15, 18, 10, 6)),
    ("2021-01-05T10:36:02,405999999+05:45", None, None, us(2021, 1, 5, 4, 51, 2, 405999)),
    ("2021-01-08T00:39:41−03:30", None, None, us(2021, 1, 8, 4, 9, 41)),
    ("2021-01-19T06:24:38 Australia/Sydney", "Asia/Tokyo", None, us(2021, 1, 18, 19, 24, 38)),
    ("2021-07-07 14:20[America/Los_Angeles]", None, None, us(2021, 7, 7, 21, 20)),
    ("2021-01-04T05:00:58 NST", "America/St_Johns", None, us(2021, 1, 4, 8, 30, 58)),
    ("2021-01-04T05:00:58 NST", None, None, None),
    ("2021-01-04T05:00:58 XYZ", "America/St_Johns", None, None),
    # a day is skipped, repeated, or settled by an abbreviation
    ("2021-03-14 02:30:00", "America/New_York", 6, None),
    ("2021-11-07 01:30:00", "America/New_York", 6, None),
    ("2021-11-07 01:30:00 EST", "America/New_York", 6, us(2021, 11, 7, 6, 30)),
    ("2021-11-07 01:30:00 -0400", "America/New_York", 6, us(2021, 11, 7, 5, 30)),
    # the order of day and month
    ("04/01/2021 03:33:10", "Etc/UTC", 0, us(2021, 1, 4, 3, 33, 10)),
    ("04/01/2021 03:33:10", "Etc/UTC", 3, us(2021, 4, 1, 3, 33, 10)),
    ("04/01/2021 03:33:10", "Etc/UTC", None, None),
    ("27/06/2024 09:25:01 +00:00", None, None, us(2024, 6, 27, 9, 25, 1)),
    ("05/05/2021 01:00:00", "Etc/UTC", None, us(2021, 5, 5, 1)),
    # no dates
    ("2022-13-05T09:00:00Z", None, None, None), ("2023-02-30 12:00:00 +0000", None, None, None), ("25:61", None, None, None),
    ("unknown", "Etc/UTC", None, None), ("", None, None, None), ("   ", None, None, None), (None, None, None, None), ("2021-01-01T00:00:00Z" * 900, None, None, None),
])
def test_notations(text, zone, weekday, want):
    assert read(text, zone, weekday) == want


@settings(max_examples=150, deadline=None)
@given(st.datetimes(datetime(1971, 1, 1), datetime(2100, 1, 1)), st.sampled_from(["Europe/Berlin", "America/St_Johns", "Australia/Sydney", "Asia/Kathmandu", "Africa/Casablanca"]))
def test_wall_times_agree_with_the_library(wall, zone):
    z = ZoneInfo(zone)
    a, b = (wall.replace(tzinfo=z, fold=f).astimezone(timezone.utc) for f in (0, 1))
    real = {x for x in (a, b) if x.astimezone(z).replace(tzinfo=None) == wall}
    want = int((real.pop() - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds() * 1_000_000 + 0.5) if len(real) == 1 else None
    got = read(wall.strftime("%Y-%m-%dT%H:%M:%S.%f"), zone)
    assert (got is None) == (want is None) and (got is None or abs(got - want) <= 1)


def test_shapes_and_tables():
    assert shape_mask("Mon, 04 Jan 2021") == "a, 99 a 9999"
    assert zone_version() != "" and zone_table("No/Where", zone_version()) is None
    reader = InstantReader()
    reader.read(pd.Series(["2021-01-01", "2022-02-02", "x"]), pd.Series([None] * 3), pd.Series([None] * 3))
    assert set(reader.parsers) == {"9999-99-99", "a"}


def test_a_table_keeps_its_columns_and_an_empty_one_gives_none(spark):
    df = spark.createDataFrame([("2021-01-04T16:00:00Z", "Asia/Tokyo", 1.0, "old"), (None, None, None, "old")], "t string, z string, w double, utc_instant string")
    out = normalise_instants(df, "t", "z", "w")
    assert out.columns == ["t", "z", "w", "utc_epoch_us", "utc_instant", "utc_hour_of_day", "utc_day_of_week"]
    r = {x.t: x for x in out.collect()}
    assert r["2021-01-04T16:00:00Z"].utc_hour_of_day == 1 and r["2021-01-04T16:00:00Z"].utc_day_of_week == 1 and r[None].utc_epoch_us is None
    assert normalise_instants(df.limit(0), "t", "z", "w").count() == 0


def test_many_fraction_digits_and_few_digits_of_seconds():
    texts = pd.Series(["2024-03-01T10:00:00." + "123456789" * 10 + "Z", "0", "86400", "-1", "99999999", "9" * 200_000, "x" * 200_000])
    got = InstantReader().read(texts, pd.Series([None] * 7), pd.Series([None] * 7))["epoch_us"]
    assert list(got[:5]) == [1709287200123456, 0, 86_400_000_000, -1_000_000, 99_999_999_000_000] and got[5:].isna().all()


def test_a_worker_forgets_shapes_beyond_the_bound(monkeypatch):
    monkeypatch.setattr(instants, "MOST_SHAPES", 3)
    reader = InstantReader()
    texts = [f"{'x ' * k}2024" for k in range(12)] + ["2024-03-01T10:00:00Z"]
    assert reader.read(pd.Series(texts), pd.Series([None] * 13), pd.Series([None] * 13))["epoch_us"][12] == 1709287200000000 and len(reader.parsers) <= 5
