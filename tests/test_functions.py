from datetime import datetime, timedelta, timezone

import pytest
from hypothesis import given, strategies as st
from pyspark.sql import functions as F

from paypulse.functions.ratio import safe_pct
from paypulse.functions.time import as_utc, bucket_ceil, bucket_start, minutes_before, ntz, shift_minutes
from paypulse.functions.variant import json_field

TIMES = [
    "1969-12-31 23:59:59.999999", "1899-01-01 00:00:00", "2024-03-10 02:30:30.123456",
    "2024-01-01 00:00:00", None,
]


@pytest.mark.parametrize("zone", ["UTC", "America/Los_Angeles", "Asia/Kolkata"])
@pytest.mark.parametrize("grain", ["second", "minute", "hour", "day"])
def test_bucket_start_is_zone_independent_and_keeps_null(spark, zone, grain):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        frame = spark.createDataFrame([(t,) for t in TIMES], "t string").select(
            F.col("t").cast("timestamp_ntz").alias("ts")
        )
        got = {
            str(r.ts): r.b
            for r in frame.select("ts", bucket_start(F.col("ts"), grain).alias("b")).collect()
        }
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    keep = {"second": "%Y-%m-%d %H:%M:%S", "minute": "%Y-%m-%d %H:%M:00", "hour": "%Y-%m-%d %H:00:00",
            "day": "%Y-%m-%d 00:00:00"}[grain]
    for text in TIMES:
        if text is None:
            assert got["None"] is None
        else:
            value = datetime.fromisoformat(text)
            assert got[str(value)] == datetime.fromisoformat(value.strftime(keep))


def test_bucket_start_refuses_other_grains():
    with pytest.raises(ValueError):
        bucket_start(None, "week")


@given(
    st.datetimes(datetime(1960, 1, 1), datetime(2060, 1, 1)),
    st.datetimes(datetime(1960, 1, 1), datetime(2060, 1, 1)),
)
def test_bucket_ceil_moves_the_comparison_to_the_source_column(ts, bound):
    minute = ts.replace(second=0, microsecond=0)
    assert (minute >= bound) == (ts >= bucket_ceil(bound))
    assert (minute < bound) == (ts < bucket_ceil(bound))


def test_window_bounds():
    assert as_utc("2024-01-01T12:00:00+02:00") == datetime(2024, 1, 1, 10)
    assert as_utc(datetime(2024, 1, 1, tzinfo=timezone.utc)) == datetime(2024, 1, 1)
    assert abs(as_utc(None) - datetime.now(timezone.utc).replace(tzinfo=None)) < timedelta(seconds=5)
    assert minutes_before(datetime(2024, 1, 1, 1), 90) == datetime(2023, 12, 31, 23, 30)
    with pytest.raises(ValueError):
        minutes_before(datetime(2024, 1, 1), -5)


def test_shift_minutes(spark):
    row = spark.range(1).select(
        shift_minutes(ntz(datetime(2024, 3, 10, 2, 45)), -30).alias("a"),
        shift_minutes(F.lit(None).cast("timestamp_ntz"), 1).alias("b"),
    ).first()
    assert row.a == datetime(2024, 3, 10, 2, 15) and row.b is None


def test_safe_pct(spark):
    frame = spark.createDataFrame([(1, 3), (0, 5), (1, 0), (1, 800), (None, 2)], "a long, b long")
    got = [r[0] for r in frame.select(safe_pct(F.col("a"), F.col("b"))).collect()]
    assert got == [33.33, 0.0, None, 0.13, None]


def test_json_field(spark):
    texts = ['{"k": 7}', '{"k": "8"}', '{"k": "x"}', '{"k": null}', "{}", "{x", None, "12"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in frame.select(json_field(F.col("t"), "k", "bigint")).collect()]
    assert got == [7, 8, None, None, None, None, None, None]
