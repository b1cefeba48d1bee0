from datetime import datetime, timezone

import pytest

from estatelens.functions.zones import tz_version, wall_to_utc, zone_table
from estatelens.operators.timestamps import parser_of, with_instant

ESTATES = [("L", "Europe/London", "dmy"), ("N", "America/New_York", "mdy"), ("B", "Europe/Berlin", "ymd"), ("K", "Asia/Kolkata", "dmy")]


def us(*a, micro=0):
    return int(datetime(*a, tzinfo=timezone.utc).timestamp()) * 1_000_000 + micro


CASES = [
    ("L", "20180921T054030Z", us(2018, 9, 21, 5, 40, 30)),
    ("L", " 2016-10-25T17:20:01.716Z\t", us(2016, 10, 25, 17, 20, 1, micro=716000)),
    ("L", "2017-01-04T12:02:39.6942669Z", us(2017, 1, 4, 12, 2, 39, micro=694266)),
    ("B", "2014-04-08T12:00:15.285304+02:00", us(2014, 4, 8, 10, 0, 15, micro=285304)),
    ("B", "2019-11-22T23:11:04+01:00[Europe/Berlin]", us(2019, 11, 22, 22, 11, 4)),
    ("N", "2014-04-08 12:00:15-05", us(2014, 4, 8, 17, 0, 15)),
    ("L", "Wed, 21 Jun 2017 19:47:59 +0100", us(2017, 6, 21, 18, 47, 59)),
    ("N", "11 May 2016 12:26:45 EDT", us(2016, 5, 11, 16, 26, 45)),
    ("L", "06 Aug 2012 14:00:36 BST", us(2012, 8, 6, 13, 0, 36)),
    ("K", "06 Aug 2012 14:00:36 BST", None),
    ("N", "05 Nov 2023 01:23:50 EST", us(2023, 11, 5, 6, 23, 50)),
    ("N", "05 Nov 2023 01:23:50 EDT", us(2023, 11, 5, 5, 23, 50)),
    ("N", "2023-11-05 01:23:50", None),  # twice
    ("N", "2025-03-09T02:45", None),  # never
    ("N", "2025-03-09T03:45", us(2025, 3, 9, 7, 45)),
    ("L", "2012-07-06T08:36:03", us(2012, 7, 6, 7, 36, 3)),
    ("L", "04/01/20 14:17", us(2020, 1, 4, 14, 17)),
    ("N", "03/28/19 12:13", us(2019, 3, 28, 16, 13)),
    ("B", "18/10/30 12:13", us(2018, 10, 30, 11, 13)),
    ("B", "2018/10/30 1:28 AM", us(2018, 10, 30, 0, 28)),
    ("L", "21/09/2013 11:54 pm", us(2013, 9, 21, 22, 54)),
    ("L", "21/09/2013 13:54 pm", None),
    ("N", "Jun 25, 2023 12:45:23 AM", us(2023, 6, 25, 4, 45, 23)),
    ("B", "5. Juni 2015 20:47", us(2015, 6, 5, 18, 47)),
    ("B", "10. März 2014 00:01", us(2014, 3, 9, 23, 1)),
    ("L", "27-Feb-2026 04:13", us(2026, 2, 27, 4, 13)),
    ("L", "1529250436", us(2018, 6, 17, 15, 47, 16)),
    ("L", "1274782734.0", us(2010, 5, 25, 10, 18, 54)),
    ("L", "1708535577556", us(2024, 2, 21, 17, 12, 57, micro=556000)),
    ("L", "132611049183574565", us(2021, 3, 25, 0, 15, 18, micro=357456)),
    ("L", "20250424181621", us(2025, 4, 24, 17, 16, 21)),
    ("L", "43737.092002315", us(2019, 9, 29, 1, 12, 29)),
    (None, "1529250436", us(2018, 6, 17, 15, 47, 16)),
    (None, "2012-07-06T08:36:03", None),
    ("other", "04/01/20 14:17", None),
    ("L", "30/02/2015 05:59", None),
    ("L", "0000-00-00 00:00:00", None),
    ("L", "1601-01-01 00:00:00", None),
    ("L", "2015-10-15", None),
    ("L", "2014-08-13T1", None),
    ("L", "N/A", None),
    ("L", "", None),
    ("L", None, None),
    ("L", "9" * 5000, None),
]


def test_cases(spark):
    files = spark.createDataFrame([(i, s, v, "clash", "clash") for i, (s, v, _) in enumerate(CASES)], "row_id bigint, source_system string, last_modified string, time_zone string, utc_micros string")
    got = {r["row_id"]: r["utc_micros"] for r in with_instant(files, spark.createDataFrame(ESTATES, "source_system string, time_zone string, date_order string")).collect()}
    wrong = [(c, got[i]) for i, c in enumerate(CASES) if got[i] != c[2]]
    assert not wrong


def test_empty_table_and_repeated_estates(spark):
    estates = spark.createDataFrame([*ESTATES, ESTATES[0]], "source_system string, time_zone string, date_order string")
    empty = spark.createDataFrame([], "row_id bigint, source_system string, last_modified string")
    assert with_instant(empty, estates).count() == 0
    one = spark.createDataFrame([(1, "L", "2012-07-06T08:36:03"), (1, "L", "2012-07-06T08:36:03")], empty.schema)
    assert with_instant(one, estates).count() == 2


def test_zone_tables_agree_with_zoneinfo():
    import random
    from zoneinfo import ZoneInfo

    import numpy as np

    rnd = random.Random(3)
    assert tz_version()
    for name in ("Europe/London", "Australia/Sydney", "America/Los_Angeles"):
        seconds = np.array([rnd.randrange(0, 2_000_000_000) for _ in range(300)], "int64")
        wall = np.array([s + int(datetime.fromtimestamp(s, ZoneInfo(name)).utcoffset().total_seconds()) for s in seconds], "int64")
        utc, once = wall_to_utc(zone_table(name), wall)
        assert (utc[once] == seconds[once]).all() and once.mean() > 0.99
    assert zone_table("No/Where") is None


@pytest.mark.parametrize("mask", ["aaa", "99:99", "9999-99-99", "", "9999-99-99a9"])
def test_masks_without_parser(mask):
    assert parser_of(mask) is None


def test_changes_of_a_zone_are_those_of_its_file():
    import bisect
    import random
    import zoneinfo
    from datetime import datetime, timezone

    from estatelens.functions.zones import listed_changes, tz_version, zone_table

    rnd = random.Random(5)
    assert tz_version() and tz_version() != "unversioned"
    for name in ("Europe/London", "America/New_York", "Africa/Casablanca", "Australia/Lord_Howe", "Asia/Kolkata", "UTC"):
        table, zone = zone_table(name), zoneinfo.ZoneInfo(name)
        near = [s + d for s in listed_changes(name) if s > 0 for d in (-1, 0, 1)] + [rnd.randrange(0, 4_102_000_000) for _ in range(300)]
        for second in near:
            at = datetime.fromtimestamp(second, timezone.utc).astimezone(zone)
            i = bisect.bisect_right(list(table.starts), second) - 1
            assert (int(at.utcoffset().total_seconds()), at.tzname()) == (table.offsets[i], table.names[i])
