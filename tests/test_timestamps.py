"""Timestamps against the standard library, and the cases without an instant."""

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.operators import timestamps as ts

ZONES = ["America/New_York", "Europe/Paris", "Asia/Kathmandu", "Australia/Sydney", "Etc/UTC", "America/Sao_Paulo", "Asia/Kolkata"]
TABLES = ts.ZoneTables.build(ZONES)
NONE = np.iinfo(np.int64).min


def one(text, zone=None, month_first=False):
    v = int(ts.parse_batch([text], [zone], [month_first], TABLES)[0])
    return None if v == NONE else v


def ms(*a, zone=timezone.utc):
    return int(datetime(*a, tzinfo=zone).timestamp() * 1000)


@pytest.mark.parametrize("zone", ZONES)
def test_local_readings_against_zoneinfo(zone):
    tz = ZoneInfo(zone)
    for k in range(0, 24 * 800):
        naive = datetime(2024, 1, 1) + timedelta(minutes=37 * k)
        early, late = (naive.replace(tzinfo=tz, fold=f) for f in (0, 1))
        back = early.astimezone(timezone.utc).astimezone(tz).replace(tzinfo=None)
        want = None if early.utcoffset() != late.utcoffset() or back != naive else int(early.timestamp() * 1000)
        if want is None or k % 97 == 0:
            assert one(naive.strftime("%Y-%m-%d %H:%M"), zone) == want, naive


@pytest.mark.parametrize(("text", "zone", "first", "want"), [
    ("2025-06-01T10:20:30Z", None, False, ms(2025, 6, 1, 10, 20, 30)), ("  2024-11-16t05:31:20z ", None, False, ms(2024, 11, 16, 5, 31, 20)),
    ("20250211T203735Z", None, False, ms(2025, 2, 11, 20, 37, 35)), ("2024-04-03T10:44:15,838+05:45", None, False, ms(2024, 4, 3, 4, 59, 15) + 838),
    ("2024-04-21T23:26:10.537869754Z", None, False, ms(2024, 4, 21, 23, 26, 10) + 537), ("1730691095.000", None, False, 1730691095000), ("1725205212414", None, False, 1725205212414),
    ("2025-09-08T09:50:31+09:00[Asia/Tokyo]", None, False, ms(2025, 9, 8, 0, 50, 31)), ("Sun, 02 Feb 2025 03:15:14 -0600", None, False, ms(2025, 2, 2, 9, 15, 14)),
    ("Mon, 02 Feb 2025 03:15:14 GMT", None, False, ms(2025, 2, 2, 3, 15, 14)), ("Sat, 30 Aug 2025 06:04:45 IST", "Asia/Kolkata", False, ms(2025, 8, 30, 0, 34, 45)),
    ("15 Jun 2025, 17:10 GMT-4", None, False, ms(2025, 6, 15, 21, 10)), ("18 Oct 2024, 20:42 GMT+5:45", None, False, ms(2024, 10, 18, 14, 57)),
    ("February 23, 2025 9:43 p.m. ET", "America/New_York", False, ms(2025, 2, 24, 2, 43)), ("November 3, 2024 1:50 a.m. EST", "America/New_York", False, ms(2024, 11, 3, 6, 50)),
    ("02/03/2025 12:05 AM", "America/New_York", True, ms(2025, 2, 3, 5, 5)), ("02/03/2025 12:05 AM", "Etc/UTC", False, ms(2025, 3, 2, 0, 5)),
    ("24 août 2024 à 23h24", "Europe/Paris", False, ms(2024, 8, 24, 21, 24)), ("30 de julio de 2025, 11:07 h", "America/Sao_Paulo", False, ms(2025, 7, 30, 14, 7)),
    ("30. Januar 2025, 02:05 Uhr", "Europe/Paris", False, ms(2025, 1, 30, 1, 5)), ("২৫ জুলাই ২০২৫, ১৯:১৭", "Asia/Kolkata", False, ms(2025, 7, 25, 13, 47)),
    ("November 3, 2024 1:50 a.m. ET", "America/New_York", False, None), ("2025-03-09 02:30", "America/New_York", False, None), ("2025-06-01 10:20", None, False, None),
    ("2025-02-29 10:20", "Etc/UTC", False, None), ("18/04/2025 10:00", "America/New_York", True, None), ("2025-06-01", "Etc/UTC", False, None), ("yesterday", "Etc/UTC", False, None),
    ("13:05 PM", "Etc/UTC", False, None), ("26/03/2025 13:45 PM", "Etc/UTC", False, None), ("{{ publish_date }}", "Etc/UTC", False, None), ("", "Etc/UTC", False, None), (None, "Etc/UTC", False, None), ("9" * 5000, None, False, None),
])
def test_forms(text, zone, first, want):
    assert one(text, zone, first) == want


def test_frame_keeps_rows_and_replaces_a_clashing_column(spark):
    df = spark.createDataFrame([(1, "2025-06-01T00:00:00Z", "Etc/UTC", None, "x"), (1, "2025-06-01T00:00:00Z", "Etc/UTC", None, "x"), (2, None, None, True, None)], "id int, v string, z string, m boolean, epoch_ms string")
    got = ts.normalise(df, "v", "z", "m", TABLES).orderBy("id").collect()
    assert [r.epoch_ms for r in got] == [ms(2025, 6, 1), ms(2025, 6, 1), None]
    assert ts.normalise(df.limit(0), "v", "z", "m", TABLES).count() == 0


def test_instants_of_tables_with_nulls(spark):
    items = spark.createDataFrame([(1, None, "2025-06-01 00:00"), (2, "a", "2025-06-01 00:00"), (3, "b", "2025-06-01T00:00:00Z")], "ordinal long, source string, published_raw string")
    articles = spark.createDataFrame([(7, "a", None, "06/02/2025 10:00")], "article_id long, source string, published string, modified string")
    feeds = spark.createDataFrame([("a", "America/New_York", "US"), ("a", "America/New_York", "US"), (None, "Europe/Paris", None), ("c", "No/Zone", None)], "name string, tz string, region string")
    got = {(r.tab_name, r.col_name, r.row_id): r.epoch_ms for r in ts.instants(items, articles, feeds).collect()}
    assert got == {("items", "published_raw", 1): None, ("items", "published_raw", 2): ms(2025, 6, 1, 4), ("items", "published_raw", 3): ms(2025, 6, 1), ("articles", "modified", 7): ms(2025, 6, 2, 14)}
    assert ts.instants(items, articles, feeds).filter(F.col("epoch_ms").isNull()).count() == 1
