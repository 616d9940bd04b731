"""Generated Date headers: Spark ages equal the standard library's parser."""

from datetime import UTC, datetime
from email.utils import parsedate_to_datetime

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from inboxlens.functions.dates import age_days, with_date_ts, age_days_from_ts

NOW = datetime(2024, 1, 3, 9, tzinfo=UTC)

weekday = st.sampled_from(["", "Mon, ", "Tue,", "wed ", "THU, ", "Friday, ", "Sat,  "])
day = st.integers(0, 32).map(str) | st.integers(1, 9).map(lambda d: f"0{d}")
month = st.sampled_from(["Jan", "jan", "FEB", "March", "sept", "Sep", "Dec", "Foo", "Jan,", "Jan."])
year = st.integers(0, 99).map(str) | st.integers(1900, 2100).map(str) | st.just("024")
hour = st.integers(0, 24).map(lambda h: f"{h:02d}") | st.integers(0, 9).map(str)
minute = st.integers(0, 60).map(lambda m: f"{m:02d}")
second = st.none() | st.integers(0, 61).map(lambda x: f"{x:02d}")
zone = st.sampled_from(["+0000", "-0000", "+0530", "-0800", "GMT", "gmt", "UT", "EST", "PDT", "XYZ", "",
                        "+05:30", "Z", "+2400", "-9999", "+100"])
glue = st.sampled_from([" ", "", "  "])
tail = st.sampled_from(["", " (UTC)", " extra words"])
order = st.booleans()


@st.composite
def headers(draw):
    d, m = draw(day), draw(month)
    head = f"{d} {m}" if draw(order) else f"{m} {d}"
    sep = draw(st.sampled_from([":", ":", ".", ":."]))
    t = f"{draw(hour)}{sep[0]}{draw(minute)}"
    sec = draw(second)
    if sec is not None:
        t += f"{sep[-1]}{sec}"
    z = draw(zone)
    rest = f"{draw(glue)}{z}{draw(tail)}" if z else draw(tail)
    y = draw(year)
    middle = f"{y} {t}" if draw(st.integers(0, 3)) else f"{t} {y}"      # mostly year first
    return f"{draw(weekday)}{head} {middle}{rest}"


def stdlib_age(h):
    try:
        return (NOW - parsedate_to_datetime(h)).days
    except Exception:  # noqa: BLE001
        return None


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(headers() | st.text(max_size=30), min_size=100, max_size=200))
def test_ages_match_stdlib(spark, hs):
    df = spark.createDataFrame([(i, h) for i, h in enumerate(hs)], "i int, d string")
    col = {r.i: r.a for r in df.select("i", age_days("d", "2024-01-03 09:00:00").alias("a")).collect()}
    staged = {r.i: r.a for r in with_date_ts(df, "d", "ts")
              .select("i", age_days_from_ts("ts", "2024-01-03 09:00:00").alias("a")).collect()}
    for i, h in enumerate(hs):
        want = stdlib_age(h)
        assert col[i] == want, (h, col[i], want)
        assert staged[i] == want, (h, staged[i], want)
