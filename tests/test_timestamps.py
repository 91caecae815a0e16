from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from threadlake.operators import timestamps as t


def us(*a, tz=timezone.utc):
    return int(datetime(*a, tzinfo=tz).timestamp()) * 1_000_000


CASES = [
    ("2025-12-20T06:17:21.508Z", us(2025, 12, 20, 6, 17, 21) + 508_000),
    ("2026-01-02T22:05:06.916+01:00", us(2026, 1, 2, 21, 5, 6) + 916_000),
    ("2025-10-26T01:00:01.749256417Z", us(2025, 10, 26, 1, 0, 1) + 749_256),
    ("2025-10-26 00:47:40,434 UTC", us(2025, 10, 26, 0, 47, 40) + 434_000),
    ("1765052687", 1765052687_000_000),
    ("1782384339.522", 1782384339_522_000),
    ("1761186298086973250", 1761186298_086_973),
    ("1783050265143", 1783050265_143_000),
    ("1782384345323977", 1782384345_323_977),
    ("  2025-10-26T00:47:47.19Z ", us(2025, 10, 26, 0, 47, 47) + 190_000),
    ("Fri, 02 Jan 2026 21:04:39 GMT", us(2026, 1, 2, 21, 4, 39)),
    ("20260912T180517Z", us(2026, 9, 12, 18, 5, 17)),
    ("2025-02-01T00:21Z", us(2025, 2, 1, 0, 21)),
    ("2025-02-01T01:23:18+0100", us(2025, 2, 1, 0, 23, 18)),
    ("2026-09-26 17:16:32 PDT", us(2026, 9, 27, 0, 16, 32)),
    ("2025-10-26 02:47:40 CEST", us(2025, 10, 26, 0, 47, 40)),
    ("25 Feb 2025 22:13:17 +0200", us(2025, 2, 25, 20, 13, 17)),
    ("2026-01-03T20:41:11.705+00:00[Europe/Lisbon]", us(2026, 1, 3, 20, 41, 11) + 705_000),
    ("2025-02-11 22:53:08 +05:30", us(2025, 2, 11, 17, 23, 8)),
    ("2025-03-23 15:12:00.471+00", us(2025, 3, 23, 15, 12) + 471_000),
    # local times of Berlin
    ("2026-07-03 12:39:45", us(2026, 7, 3, 10, 39, 45)),
    ("Sep 12, 2026 8:01:37 PM", us(2026, 9, 12, 18, 1, 37)),
    ("Feb 7, 2026 12:12:00 AM", us(2026, 2, 6, 23, 12)),
    ("2025-10-26 02:30:00", us(2025, 10, 26, 0, 30)),  # twice: the first
    ("2025-03-30 02:30:00", us(2025, 3, 30, 1, 30)),  # skipped: the offset before
    ("2025-03-30T03:00:00", us(2025, 3, 30, 1)),
    *((bad, None) for bad in (None, "", "  ", "n/a", "yesterday", "0001-01-01T00:00:00Z", "2025-02-30T00:00:00Z", "2025-13-01T00:00:00Z", "2025-01-01T25:00:00Z", "0", "-1", "2025-01-01 10:00:00 QQT", "13 PM")),
]


@pytest.fixture(scope="module")
def solved(spark):
    rows = spark.createDataFrame([(i, s, "berlin", "clash") for i, (s, _) in enumerate(CASES)], "k int, s string, o string, zone string")
    zones = spark.createDataFrame([("berlin", "Europe/Berlin"), ("none", None)], "owner string, zone string")
    return {int(r["key"]): (r["epoch_us"], r["told"]) for r in t.normalize_times(rows, "k", "s", "o", zones).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_spellings(solved, i):
    assert solved[i][0] == CASES[i][1], CASES[i][0]


def test_how_an_instant_was_found(solved):
    told = {CASES[i][0]: how for i, (_, how) in solved.items()}
    assert told["2025-10-26 02:30:00"] == "ambiguous" and told["2025-03-30 02:30:00"] == "skipped" and told["2026-07-03 12:39:45"] == "local"
    assert told["1765052687"] == told["2025-02-01T00:21Z"] == "zone" and told["n/a"] is None and told["2025-13-01T00:00:00Z"] is None


def test_years_and_kept_columns(spark):
    rows = spark.createDataFrame([("a", "1999-07-03 12:00:00", "b", 1, "x"), ("b", "2026-01-03 12:00:00", "b", 2, "y"), ("b", None, None, None, None)], "key string, at string, o string, told int, extra string")
    zones = spark.createDataFrame([("b", "Europe/Berlin")], "owner string, zone string")
    every = {r["extra"]: r["epoch_us"] for r in t.normalize_times(rows.drop("told"), "key", "at", "o", zones, keep=["extra"]).collect()}
    assert every == {"x": us(1999, 7, 3, 10), "y": us(2026, 1, 3, 11), None: None}
    some = {r["key"]: r["epoch_us"] for r in t.normalize_times(rows.filter("extra is not null"), "key", "at", "o", zones, (2025, 2027)).collect()}
    assert some == {"a": None, "b": us(2026, 1, 3, 11)}


def test_no_zone_gives_nothing_and_empty_tables(spark):
    rows = spark.createDataFrame([("a", "2026-07-03 12:39:45", "none"), ("b", "2026-07-03 12:39:45", None)], "k string, s string, o string")
    zones = spark.createDataFrame([("none", None)], "owner string, zone string")
    assert [r["epoch_us"] for r in t.normalize_times(rows, "k", "s", "o", zones).collect()] == [None, None]
    assert t.normalize_times(rows.limit(0), "k", "s", "o", zones).count() == 0


def test_numbers(spark):
    rows = spark.createDataFrame([(v,) for v in (1773687559655, 1770433036, 1776660181219683, 1773688745803238375, 0, -1, None, -62135596800000)], "v long")
    assert [r[0] for r in rows.select(t.epoch_from_number(F.col("v"))).collect()] == [1773687559655000, 1770433036000000, 1776660181219683, 1773688745803238, None, None, None, None]
    assert rows.select(t.epoch_from_number(F.lit(99_000_000_000), (2025, 2027))).first()[0] is None


def test_segments_agree_with_the_zone_database(spark):
    seg = {}
    for r in t.local_segments(spark).filter(F.col("zone").isin("America/New_York", "Asia/Kolkata", "Australia/Sydney")).collect():
        seg.setdefault(r["zone"], []).append(r)
    for zone, rows in seg.items():
        for month in range(1, 13):
            for hour in (0, 1, 2, 3, 12):
                naive = datetime(2026, month, 1, hour)
                at = int(naive.replace(tzinfo=timezone.utc).timestamp()) * 1_000_000
                (hit,) = [r for r in rows if r["local_from"] <= at < r["local_to"]]
                assert at - hit["shift"] == int(naive.replace(tzinfo=ZoneInfo(zone)).timestamp()) * 1_000_000
