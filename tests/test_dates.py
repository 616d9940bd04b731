from datetime import UTC, datetime
from email.utils import parsedate_to_datetime

import pytest

from inboxlens.functions.dates import age_days, is_stale, with_date_ts

AS_OF = "2024-01-03 09:00:00"
# (header, whole days at AS_OF) -- values of the standard library's parser
CASES = [
    ("Mon, 1 Jan 2024 10:00:00 +0000", 1),
    ("Mon, 1 Jan 2024 10:00:00 +0000 (UTC)", 1),
    ("1 Jan 2024 10:00:00 GMT", 1),
    ("Mon, 01 Jan 24 10:00 EST", 1),
    ("Mon, 1 Jan 2024 10:00:00 -0000", None),
    ("Mon, 1 Jan 2024 10:00:00", None),
    ("Mon, 1 Jan 2024 10:00:00 XYZ", None),
    ("Unknown", None),
    ("Jan 1 2024 10:00:00 +0100", 2),
    ("Mon 1 Jan 2024 10:00:00 +0530", 2),
    ("1 Jan 2024 10:00:00+0000", 1),
    ("Tue, 2 January 2024 09:00:00 -0800", 0),
    ("Mon, 1 Jan 99 10:00:00 +0000", 9132),
    ("Fri, 5 Jan 2024 10:00:00 +1300", -2),
    ("Mon, 1 Jan 2024 10:00:60 +0000", None),
    ("Mon, 31 Feb 2024 10:00:00 +0000", None),
    ("", None),
    (None, None),
]


def _stdlib_age(header):
    now = datetime(2024, 1, 3, 9, tzinfo=UTC)
    try:
        return (now - parsedate_to_datetime(header)).days
    except Exception:  # noqa: BLE001 - any failure means "no age"
        return None


@pytest.mark.parametrize("header,want", CASES)
def test_age_days(spark, header, want):
    assert want == _stdlib_age(header)
    df = spark.createDataFrame([(header,)], "d string")
    assert df.select(age_days("d", AS_OF).alias("a")).first().a == want
    staged = with_date_ts(df, "d", "ts").select(age_days("d", AS_OF).alias("a")).first().a
    assert staged == want


def test_future_is_negative(spark):
    df = spark.createDataFrame([("Mon, 1 Jan 2024 10:00:00 +0000",)], "d string")
    assert df.select(age_days("d", "2024-01-01 09:00:00").alias("a")).first().a == -1


def test_is_stale_boundaries(spark):
    df = spark.createDataFrame([("2023-12-27T09:00:00+00:00",), ("2023-12-27T09:00:01",)], "f string")
    got = [r.s for r in df.select(is_stale("f", 7, AS_OF).alias("s")).collect()]
    assert got == [True, False]
