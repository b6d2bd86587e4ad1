import pytest
from pyspark.sql import functions as F

from paypulse.operators import health
from paypulse.operators.landing import land_raw
from paypulse.schemas import COMMITTED, ENVELOPE

from tests.conftest import at, rows_of


@pytest.fixture
def log(spark):
    rows = [("k", "{}", "payments", p, o, at("10:00")) for p, end in ((0, 4), (1, 2)) for o in range(end)]
    rows += [("k", "{}", "orders", 0, o, at("10:00")) for o in range(7, 9)]
    return spark.createDataFrame(rows, ENVELOPE)


@pytest.fixture
def committed(spark):
    return spark.createDataFrame([
        ("g", "payments", 0, 1), ("g", "payments", 0, 3), ("g", "payments", 1, None),
        ("g", "payments", 9, 5), ("other", "payments", 1, 2), ("g", "orders", 0, 20),
    ], COMMITTED)


def test_end_offsets(log):
    assert rows_of(health.end_offsets(log)) == [("orders", 0, 9), ("payments", 0, 4), ("payments", 1, 2)]
    assert rows_of(health.end_offsets(log, "orders")) == [("orders", 0, 9)]
    assert rows_of(health.end_offsets(log, "unknown")) == []


def test_consumer_lag(log, committed):
    assert rows_of(health.consumer_lag(log, committed, "payments", "g")) == [(0, 4, 3, 1), (1, 2, 0, 2)]
    # A commit ahead of the log is not clamped, a group without commits lags by everything.
    assert rows_of(health.consumer_lag(log, committed, "orders", "g")) == [(0, 9, 20, -11)]
    assert rows_of(health.consumer_lag(log, committed, "payments", "new")) == [(0, 4, 0, 4), (1, 2, 0, 2)]


def test_total_lag(log, committed):
    for topic, lag in (("payments", 3), ("orders", -11), ("unknown", 0)):
        assert rows_of(health.total_lag(log, committed, topic, "g")) == [(topic, "g", lag)]


def test_new_records(log, committed):
    got = health.new_records(log, committed, "g").select("topic", "partition", "offset")
    assert rows_of(got) == [("payments", 0, 3), ("payments", 1, 0), ("payments", 1, 1)]
    assert health.new_records(log, committed, "new").count() == log.count()


def test_commits_of_landed_rows(log):
    raw = land_raw(log)
    assert rows_of(health.group_commits(health.raw_log(raw), "g")) == [
        ("g", "orders", 0, 9), ("g", "payments", 0, 4), ("g", "payments", 1, 2),
    ]


def test_throughput_and_summary(log, committed, orders, payments):
    load = F.when(F.col("offset") % 2 == 0, F.lit("2024-01-01 10:27:00")).otherwise(
        F.lit("2024-01-01 10:00:00")
    ).cast("timestamp_ntz")
    raw = land_raw(log, load)
    raw_orders = raw.where(F.try_variant_get("record_metadata", "$.topic", "string") == "orders")
    raw_payments = raw.where(F.try_variant_get("record_metadata", "$.topic", "string") == "payments")
    tables = (raw_orders, raw_payments, orders([("a", "10:00")]), payments([]))
    throughput = health.ingest_throughput(*tables, as_of=at("10:30"))
    assert throughput.columns == [
        "orders_5min", "payments_5min", "curated_orders_total", "curated_payments_total",
    ]
    assert rows_of(throughput) == [(1, 3, 1, 0)]
    summary = health.pipeline_summary(log, committed, *tables, as_of=at("10:30"), group="g")
    assert summary.columns[:2] == ["orders_lag", "payments_lag"]
    assert rows_of(summary) == [(-11, 3, 1, 3, 1, 0)]
