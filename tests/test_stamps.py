import datetime as dt
import random
from zoneinfo import ZoneInfo

import pytest

from lifeweave.operators.stamps import normalise_stamps

SCHEMA = "i int, raw_value string, zone_name string, locale_code string, source string"


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, *(list(r) + [None] * 4)[:4]) for i, r in enumerate(rows)], SCHEMA)
    return [r["utc_ms"] for r in sorted(normalise_stamps(df, **more).collect(), key=lambda r: r["i"])]


def ms(text):
    return round(dt.datetime.fromisoformat(text).timestamp() * 1000)


def test_formats(spark):
    T = "2021-12-25T19:14:51+00:00"
    cases = {
        ("2021:12:25 20:14:51", "Europe/Paris"): T, ("2021:12:25 19:14:51+00:00",): T, (" 2021-12-25T19:14:51Z\n",): T, ("2021-12-25T19:14:51z",): T, ("2021-12-25 21:14:51 MSK",): "2021-12-25T18:14:51+00:00",
        ("Sat Dec 25 19:14:51 +0000 2021",): T, ("Sat, 25 Dec 2021 20:14:51 +0100",): T, ("25 Dec 2021, 19:14:51 UTC",): T, ("Dec 25, 2021, 7:14:51 PM UTC",): T, ("Dec 25, 2021 2:14:51 PM EST",): T, ("Dec 26, 2021 12:59:51 AM GMT+5:45",): T,
        ("25/12/2021 19:14", "UTC", "en_GB"): "2021-12-25T19:14:00+00:00", ("12/25/2021, 7:14:51 PM", "UTC", "en_US"): T, ("25.12.21, 19:14:51", "UTC", "de_DE"): T, ("25.12.2021 19:14:51", "UTC", "de_DE"): T,
        ("IMG_20211225_191451_01.jpg", "UTC"): T, ("2021-12-25 19.14.51.jpg", "UTC"): T, ("Screenshot_2021-12-25-19-14-51.png", "UTC"): T, ("2021-12-25T20:14:51[Europe/Paris]",): T, ("2021-12-25T20:14:51+01:00[Europe/Paris]",): T, ("2021-12-25T14:14:51-05",): T,
        ("1640459691",): T, ("1640459691000",): T, ("1640459691000000",): T, ("1640459691000000000",): T, ("1.640459691E9",): T, ("12/25/2021, 12:00:00 AM", "UTC", "en_US"): "2021-12-25T00:00:00+00:00", ("2020-02-29T23:59:59Z",): "2020-02-29T23:59:59+00:00",
    }
    assert run(spark, cases) == [ms(v) for v in cases.values()]
    assert run(spark, [("PXL_20211225_191451123.jpg", "UTC"), ("2021-12-25T19:14:51.987654321Z",), ("1640459691.9879",)]) == [ms("2021-12-25T19:14:51+00:00") + x for x in (123, 987, 987)]


def test_no_instant(spark):
    bad = [(None, "UTC"), ("", "UTC"), ("  ", "UTC"), ("0", "UTC"), ("0000:00:00 00:00:00", "UTC"), ("2018-02-30T10:00:00Z",), ("2022:13:45 25:61:00", "UTC"), ("2021-12-25", "UTC"), ("2021", "UTC"), ("25.12.2021", "UTC", "de_DE"), ("unknown", "UTC"), ("null",), ("    :  :     :  :  ", "UTC"),
           ("2021:12:25 19:14:51", None), ("2021:12:25 19:14:51", "Mars/Base"), ("05/11/2017 02:32", "UTC", None), ("Sun Dec 25 19:14:51 +0000 2021",), ("2021-12-25T24:00:00Z",), ("13/25/2021, 7:14:51 PM", "UTC", "en_US"), ("2021-12-25T19:14:51 XYZ",), ("x" * 100_000, "UTC"), ("9" * 60,)]
    assert run(spark, bad) == [None] * len(bad)


def test_clock_changes_and_policies(spark):
    rows = [("2016:10:30 02:30:00", "Europe/Berlin"), ("2016:03:27 02:30:00", "Europe/Berlin"), ("2019-10-06 02:15:00", "Australia/Lord_Howe"), ("2016:10:30 01:59:59", "Europe/Berlin")]
    assert run(spark, rows)[:3] == [None, None, None]
    assert run(spark, rows, ambiguous="earlier")[0] == ms("2016-10-30T00:30:00+00:00") and run(spark, rows, ambiguous="later")[0] == ms("2016-10-30T01:30:00+00:00")
    assert run(spark, rows, nonexistent="shift_forward")[1] == ms("2016-03-27T01:30:00+00:00")
    assert run(spark, rows)[3] == ms("2016-10-29T23:59:59+00:00")


@pytest.mark.parametrize("session", ["UTC", "America/New_York"])
def test_wall_clocks_against_the_zone_database(spark, session):
    r = random.Random(1)
    zones = ["Europe/London", "America/Los_Angeles", "Asia/Kathmandu", "Australia/Sydney", "America/St_Johns", "Africa/Casablanca"]
    rows, want = [], []
    for _ in range(300):
        z = ZoneInfo(r.choice(zones))
        t = dt.datetime(2016, 1, 1) + dt.timedelta(minutes=r.randrange(8 * 525_600))
        if r.random() < 0.5:  # near the changes of many zones
            t = dt.datetime(r.choice([2017, 2020]), r.choice([3, 4, 10, 11]), r.randint(1, 30), r.randint(0, 3), r.randint(0, 59))
        rows.append((t.strftime("%Y:%m:%d %H:%M:%S"), z.key))
        found = {a.timestamp() for a in (t.replace(tzinfo=z, fold=f) for f in (0, 1)) if dt.datetime.fromtimestamp(a.timestamp(), z).replace(tzinfo=None) == t}
        want.append(round(found.pop() * 1000) if len(found) == 1 else None)
    spark.conf.set("spark.sql.session.timeZone", session)
    try:
        assert run(spark, rows) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_source_zones_extra_columns_and_empty(spark):
    lookup = spark.createDataFrame([("s", "Asia/Tokyo")], "source string, default_zone string")
    rows = [("2021:12:25 19:14:51", None, None, "s"), ("2021:12:25 19:14:51", "UTC", None, "s"), ("2021:12:25 19:14:51", None, None, "other")]
    assert run(spark, rows, source_zones=lookup) == [ms("2021-12-25T10:14:51+00:00"), ms("2021-12-25T19:14:51+00:00"), None]
    df = spark.createDataFrame([], SCHEMA + ", year int, v string")
    assert normalise_stamps(df).columns == [*df.columns, "utc_ms"] and normalise_stamps(df).collect() == []
