from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

import numpy as np
import pyarrow as pa
import pytest

from tidegrid.operators import timestamps as ts
from tidegrid.operators import zones


def one(text, year=None, created="2024-06-01 00:00:00", plain=None):
    made = np.array([int(datetime.fromisoformat(created).replace(tzinfo=timezone.utc).timestamp() * 1e6)]) if created else np.array([ts.NO_TIME])
    s, e, p = ts.parse_times(pa.array([text], pa.string()), pa.array([year], pa.string()), made, plain)
    return ts.instants(s, e)[0].as_py(), bool(p[0])


@pytest.mark.parametrize(
    "text, instant",
    [
        ("2024-08-17 19:30", "2024-08-17 11:30:00"),
        ("2024,08-1,22,11,00,00", "2024-08-22 11:00:00"),
        ("1649533539995", "2022-04-09 19:45:39"),
        ("1579084240", "2020-01-15 10:30:40"),
        ("1519650000253661", "2018-02-26 13:00:00"),
        ("20250417T004500+0800", "2025-04-16 16:45:00"),
        ("2024-12-14 19:30 JST", "2024-12-14 10:30:00"),
        ("06.10.2013 13:15 (Europe/Berlin)", "2013-10-06 11:15:00"),
        ("2017-03-26 01:08 Europe/London", "NONEXISTENT"),
        ("2019-10-27 02:34 [Europe/Berlin]", "AMBIGUOUS"),
        ("2019-10-27 02:34+02:00 [Europe/Berlin]", "2019-10-27 00:34:00"),
        ("2020-08-20 23:00 GMT+9", "2020-08-20 14:00:00"),
        ("2022-10-19T19:30:29.351784+00:00", "2022-10-19 19:30:29"),
        ("Oct 29, 2024 12:05 AM", "2024-10-28 16:05:00"),
        ("21 Nov 2019 19:30 GMT", "2019-11-21 19:30:00"),
        (" 2024-08-17 19:30 ", "2024-08-17 11:30:00"),
        ("2021-13-41 09:00", "UNREADABLE"), ("31-31 24:77", "UNREADABLE"), ("25:61", "UNREADABLE"), ("", "UNREADABLE"), ("TBC", "UNREADABLE"),
        ("2020-02-30T10:00:00Z", "UNREADABLE"), ("2024-08-17 19:30 Nowhere/City", "UNREADABLE"), ("x" * 5000, "UNREADABLE"), (None, None),
    ],
)
def test_forms(text, instant):
    assert one(text)[0] == instant


def test_long_texts():
    # blanks and digits of a fraction do not count, whatever their number
    assert one("2024-08-17" + " " * 100 + "19:30")[0] == "2024-08-17 11:30:00"
    assert one("2024-08-17" + " " * 10_000 + "19:30:00." + "1" * 5_000 + " Europe/Berlin")[0] == "2024-08-17 17:30:00"
    assert one("September 29, 2024 12:05:33.123456789 AM [America/Argentina/ComodRivadavia]")[0] == "2024-09-29 03:05:33"
    assert one("2024-08-17 19:30" + "x" * 100)[0] == "UNREADABLE"


@pytest.mark.parametrize("text, instant", [("2024-07-01 12:00 America/New_York", "2024-07-01 16:00:00"), ("2012-01-01 12:00 Europe/Moscow", "2012-01-01 08:00:00"), ("2020-07-01 12:00 Europe/Istanbul", "2020-07-01 09:00:00"), ("1990-07-01 12:00 Europe/Berlin", "1990-07-01 10:00:00"), ("2060-07-01 12:00 Europe/Berlin", "2060-07-01 10:00:00"), ("2150-07-01 12:00 Europe/Berlin", "UNREADABLE"), ("2024-11-03 01:30 America/New_York", "AMBIGUOUS")])
def test_regions_of_the_database(text, instant):
    if not zones.current_version().startswith("tzdb-"):
        pytest.skip("no zone database here")
    assert one(text)[0] == instant


def test_versions():
    def of(text, version):
        s, e, _ = ts.parse_times(pa.array([text]), version=version)
        return ts.instants(s, e)[0].as_py()

    assert of("1990-07-01 12:00 Europe/Berlin", "eu-1996") == "UNREADABLE" and of("2024-07-01 12:00 America/New_York", "eu-1996") == "UNREADABLE"
    for region in ("Europe/Berlin", "Europe/London", "Asia/Tokyo", "Asia/Shanghai"):
        for month in range(1, 13):
            for year in (1996, 2019, 2037, 2080):
                text = f"{year}-{month:02}-28 02:30 {region}"
                assert of(text, "eu-1996") == of(text, zones.current_version())
    with pytest.raises(ValueError):
        of("2024-07-01 12:00", "tzdb-1970a")


def test_yearless():
    assert one("05-31 10:00")[0] == "2024-05-31 02:00:00"
    assert one("06-01 08:00")[0] == "2024-06-01 00:00:00"
    assert one("06-01 08:01")[0] == "2023-06-01 00:01:00"
    assert one("02-29 10:00", created="2023-06-01 00:00:00")[0] == "2020-02-29 02:00:00"
    assert one("02-29 10:00", year="2023")[0] == "UNREADABLE"
    assert one("12-31 23:00", year="2019")[0] == "2019-12-31 15:00:00"
    assert one("12-31 23:00", year=" ")[0] == "2023-12-31 15:00:00"
    assert one("12-31 23:00", created=None)[0] == "UNREADABLE"


def test_plain_forms():
    assert one("2024-08-17 19:30", plain=ts.PLAIN_FULL)[1] and not one("2024-02-30 19:30", plain=ts.PLAIN_FULL)[1]
    assert not one("4-1 04:37", plain=ts.PLAIN_SHORT)[1] and one("4-1 04:37", plain=ts.PLAIN_LOOSE)[1]


@pytest.mark.parametrize("region", ["Europe/Berlin", "Europe/London", "Asia/Tokyo"])
def test_zones_as_in_the_public_rules(region):
    try:
        zone = ZoneInfo(region)
    except ZoneInfoNotFoundError:
        pytest.skip("no zone files here")
    at = datetime(2012, 1, 1)
    while at < datetime(2024, 1, 1):
        folds = {at.replace(tzinfo=zone, fold=f).astimezone(timezone.utc) for f in (0, 1)}
        back = {u.astimezone(zone).replace(tzinfo=None) for u in folds}
        want = "NONEXISTENT" if at not in back else "AMBIGUOUS" if len(folds) == 2 else f"{folds.pop():%Y-%m-%d %H:%M:%S}"
        assert one(f"{at:%Y-%m-%d %H:%M} {region}")[0] == want
        at += timedelta(hours=37, minutes=30)
    for text in ("2023-03-26 02:00", "2023-03-26 01:00", "2023-10-29 02:59", "2023-10-29 01:30"):
        at = datetime.fromisoformat(text)
        folds = {at.replace(tzinfo=zone, fold=f).astimezone(timezone.utc) for f in (0, 1)}
        back = {u.astimezone(zone).replace(tzinfo=None) for u in folds}
        want = "NONEXISTENT" if at not in back else "AMBIGUOUS" if len(folds) == 2 else f"{folds.pop():%Y-%m-%d %H:%M:%S}"
        assert one(f"{text} {region}")[0] == want
