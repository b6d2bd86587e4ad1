"""The physical plans are the ones wanted at scale."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from paypulse.operators import metrics, upsert
from paypulse.operators.metrics import revenue_per_minute
from paypulse.plans import inputs

SF = "/root/testdata/sf0.001"
BATCH_QUERIES = [n for n in driver.core_queries() if not n.startswith("stream_")]


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def scans(text):
    return re.findall(r"FileScan.*", text)


@pytest.mark.parametrize("name", BATCH_QUERIES)
def test_no_python_and_no_cross_join(spark, name):
    text = plan(driver.core_queries()[name](spark, SF))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Arrow"):
        assert bad not in text


def test_time_filter_reaches_the_scan(spark):
    for name in ("revenue_last_minutes", "payment_failure_rate_last", "revenue_anomaly"):
        text = plan(driver.core_queries()[name](spark, SF))
        assert "GreaterThanOrEqual(ts," in text, name
    text = plan(driver.order_conversion_last(spark, SF))
    assert "GreaterThanOrEqual(o_orderdate," in text
    lines = [s for s in scans(text) if "l_orderkey" in s]
    assert len(lines) == 1 and "l_shipdate" not in lines[0]


def test_anomaly_scans_once(spark):
    text = plan(driver.revenue_anomaly(spark, SF))
    assert len(scans(text)) == 1 and text.count("Exchange") == 2


def test_only_needed_columns_are_read(spark):
    text = plan(driver.revenue_per_minute(spark, SF))
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string,value:double>" in text
    text = plan(driver.payment_failure_rate(spark, SF))
    assert "value" not in scans(text)[0]


def test_revenue_leaves_out_the_other_measures(spark):
    text = plan(revenue_per_minute(inputs.event_payments(spark, SF)))
    assert "count" not in text


def test_minute_metrics_shuffle_partial_sums_only(spark):
    text = plan(driver.payment_failure_rate(spark, SF))
    assert text.count("Exchange") == 1 and "partial_count" in text


def test_conversion_reduces_both_sides_before_the_join(spark):
    text = plan(driver.order_conversion(spark, SF))
    assert "Expand" not in text
    paid = text[text.index("l_orderkey"):]
    assert "l_returnflag" in paid and text.count("HashAggregate") == 6


def test_no_sort_below_the_top_k(spark):
    text = plan(driver.order_conversion_newest(spark, SF))
    assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text


def test_latest_by_key_limits_groups_before_the_shuffle(spark):
    frame = upsert.latest_by_key(inputs.star_payments(spark, SF), "payment_id", "load_time", "seq")
    text = plan(frame)
    limits = [m.start() for m in re.finditer("WindowGroupLimit", text)]
    assert len(limits) == 2 and limits[0] < text.index("Exchange") < limits[1]
    # Columns nobody asks for are not read.
    amounts = plan(frame.groupBy("status").agg(F.sum("amount")))
    assert "l_returnflag" in amounts and "l_discount" not in amounts
    assert "l_orderkey" in amounts and amounts.count("FileScan") == 1


def test_new_records_does_not_shuffle_the_log(spark):
    frame = driver.append_only_delta(spark, SF)
    frame.collect()
    assert "BroadcastHashJoin" in plan(frame)


def test_conversion_last_filters_orders_only(spark):
    orders, payments = inputs.star_orders(spark, SF), inputs.star_payments(spark, SF)
    text = plan(metrics.order_conversion_last(orders, payments, "1998-01-01", 60))
    assert "EqualTo(l_returnflag" not in text or "GreaterThanOrEqual(l_shipdate" not in text


def test_conversion_last_reduces_payments_before_their_shuffle(spark):
    frame = driver.order_conversion_last(spark, SF)
    broadcast = sorted(map(tuple, frame.collect()))
    final = plan(frame).split("== Initial Plan ==")[0]
    # The scan of the payments meets the ids of the orders first, and only then an exchange.
    scan = next(k for k, line in enumerate(final.splitlines()) if "l_orderkey" in line and "FileScan" in line)
    above = [line for line in final.splitlines()[:scan][::-1] if "Join" in line or "Exchange hash" in line]
    assert "LeftSemi" in above[0]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(tuple, driver.order_conversion_last(spark, SF).collect())) == broadcast
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
