import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillseek.functions import datemath, geo, intervals, text

NOW = lambda: dt.datetime(2024, 1, 31, 10, 30)


@pytest.mark.parametrize(
    ("literal", "start", "end"),
    [
        ("now", "2024-01-31T10:30", None), ("now-1d/d", "2024-01-30", "2024-01-31"), ("now/M", "2024-01-01", "2024-02-01"), ("now+1M", "2024-02-29T10:30", None),
        ("2024-01-05", "2024-01-05", "2024-01-06"), ("2024-01", "2024-01-01", "2024-02-01"), ("2024-01-05||+1M/M", "2024-02-01", "2024-03-01"),
        ("2024-01-05T03:04:05Z", "2024-01-05T03:04:05", "2024-01-05T03:04:06"), ("2024-01-05T03:00+02:00", "2024-01-05T01:00", "2024-01-05T01:01"), ("now/w", "2024-01-29", "2024-02-05"),
    ],
)
def test_date_math(literal, start, end):
    got = datemath.evaluate(literal, NOW)
    assert got[0] == dt.datetime.fromisoformat(start)
    assert got[1] == (dt.datetime.fromisoformat(end) if end else got[0] + dt.timedelta(microseconds=1))


def test_zones_and_errors():
    assert datemath.evaluate("2024-01-05", NOW, "America/Chicago")[0] == dt.datetime(2024, 1, 5, 6)
    assert datemath.zone_name("-5h") == "-05:00" and datemath.zone_name("1h") == "+01:00"
    for bad in ("yesterday", "now-1x", "2024-13-01", "2024-01-05+1d"):
        assert not datemath.is_date(bad)
    with pytest.raises(datemath.DateMathError):
        datemath.strict("now/d")
    assert datemath.strict("now-3d") == "now-3d"


@pytest.mark.parametrize(("given", "want"), [("1m", ("calendar", "minute")), ("1M", ("calendar", "month")), ("week", ("calendar", "week")), ("23m", ("fixed", 1380.0)), ("1.5h", ("fixed", 5400.0)), ("2d", ("fixed", 172800.0)), (None, ("calendar", "day"))])
def test_intervals(given, want):
    assert intervals.interval(given) == want


def test_interval_of_a_range():
    day = dt.datetime(2024, 1, 1)
    assert intervals.interval(None, day, day + dt.timedelta(days=400)) == ("fixed", 345600.0)
    assert intervals.interval(None, day, day + dt.timedelta(hours=1)) == ("fixed", 30.0)


def test_places(spark):
    assert geo.distance_metres("75mi") == pytest.approx(120700.8) and geo.distance_metres(None) == pytest.approx(16093.44)
    assert geo.location("1.5,-2") == (1.5, -2.0)
    south, north, west, east = geo.geohash_box("u4pruyd")
    row = spark.createDataFrame([(57.64911, 10.40744)], "lat double, lon double").select(geo.geohash(F.col("lat"), F.col("lon"), 7).alias("h"), geo.haversine(F.col("lat"), F.col("lon"), (57.64911, 11.40744)).alias("m")).first()
    assert row.h == "u4pruyd" and south <= 57.64911 <= north and west <= 10.40744 <= east and 59_000 < row.m < 60_000


def test_text(spark):
    df = spark.createDataFrame([("The Quick_fox, émile!",), (None,), ("",)], "t string")
    rows = df.select(text.tokens(F.col("t")).alias("k"), text.match_any(F.col("t"), "FOX quick_fox").alias("m"), text.phrase(F.col("t"), "quick_fox Émile").alias("p"), text.sort_form(F.col("t")).alias("s")).collect()
    assert rows[0].k == ["the", "quick_fox", "émile"] and rows[0].m and rows[0].p and rows[0].s == "the quick_fox, emile!"
    assert rows[1].k is None and rows[2].k == []
