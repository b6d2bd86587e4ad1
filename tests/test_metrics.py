import random

import pytest

from paypulse.operators import metrics

from tests.conftest import at, rows_of


def test_revenue_per_minute_edges(payments):
    frame = payments([
        ("1", "a", "PAID", 10.0, "10:00:01"), ("2", "a", "FAILED", 99.0, "10:00:59"),
        ("3", "b", "FAILED", 5.0, "10:01"),
        ("4", "c", "PAID", None, "10:02"), ("5", "c", "PAID", 2.5, "10:02"),
        ("6", "d", "PAID", None, "10:03"),
        ("7", "e", None, 7.0, "10:04"),
        ("8", "f", "PAID", 1.0, None),
    ])
    assert rows_of(metrics.revenue_per_minute(frame)) == sorted([
        (at("10:00"), 10.0), (at("10:01"), 0.0), (at("10:02"), 2.5), (at("10:03"), None),
        (at("10:04"), 0.0), (None, 1.0),
    ], key=repr)
    assert rows_of(metrics.payment_failure_rate(frame)) == sorted([
        (at("10:00"), 2, 1, 50.0), (at("10:01"), 1, 1, 100.0), (at("10:02"), 2, 0, 0.0),
        (at("10:03"), 1, 0, 0.0), (at("10:04"), 1, 0, 0.0), (None, 1, 0, 0.0),
    ], key=repr)


def test_grain(payments):
    frame = payments([("1", "a", "PAID", 1.0, "10:01"), ("2", "a", "PAID", 2.0, "10:59")])
    assert rows_of(metrics.revenue_per_minute(frame, "hour")) == [(at("10:00"), 3.0)]


def test_order_conversion_edges(orders, payments):
    frame = orders([
        ("twice", "10:00"), ("unpaid", "10:00"), ("failed", "10:00"),
        ("late", "10:01"), (None, "10:02"), ("untimed", None), (None, "10:00"),
        ("same", "10:03"), ("same", "10:03"), ("same", "10:04"),
    ])
    paid = payments([
        ("1", "twice", "PAID", 1.0, "10:00"), ("2", "twice", "PAID", 1.0, "10:05"),
        ("3", "failed", "FAILED", 1.0, "10:00"), ("4", "late", "PAID", 1.0, "23:00"),
        ("5", "orphan", "PAID", 1.0, "10:00"), ("6", None, "PAID", 1.0, "10:02"),
        ("7", "untimed", "PAID", 1.0, None), ("8", "same", "PAID", 1.0, "10:03"),
    ])
    assert rows_of(metrics.order_conversion(frame, paid)) == sorted([
        (at("10:00"), 3, 1, 33.33), (at("10:01"), 1, 1, 100.0), (at("10:02"), 0, 0, None),
        (None, 1, 1, 100.0), (at("10:03"), 1, 1, 100.0), (at("10:04"), 1, 1, 100.0),
    ], key=repr)


def test_last_minutes_have_no_upper_bound_and_a_cap(payments, orders):
    frame = payments([(str(m), "a", "PAID", float(m), f"10:{m:02d}:30") for m in range(60)])
    got = metrics.revenue_last_minutes(frame, at("10:30:30"), 10)
    # 10:20 is before the bound of 10:20:30, its rows are not counted in part.
    assert [r.minute for r in got.collect()] == [at(f"10:{m:02d}") for m in range(59, 20, -1)]
    assert [r.minute for r in metrics.revenue_last_minutes(frame, at("10:30"), 10, cap=3).collect()] == [
        at("10:59"), at("10:58"), at("10:57")
    ]
    assert metrics.payment_failure_rate_last(frame, at("10:30"), 0).count() == 30
    some = orders([("a", "10:00"), ("b", "10:40")])
    assert rows_of(metrics.order_conversion_last(some, frame, at("10:30"), 5)) == [(at("10:40"), 1, 0, 0.0)]
    with pytest.raises(ValueError):
        metrics.revenue_last_minutes(frame, at("10:30"), -5)


def test_anomaly(payments):
    frame = payments([
        ("1", "a", "PAID", 30.0, "10:26"), ("2", "a", "PAID", 10.0, "10:27"), ("3", "a", "FAILED", 9.0, "10:28"),
        ("4", "a", "PAID", 7.0, "10:24"), ("5", "a", "PAID", 9.0, "09:56"),
        ("6", "a", "PAID", 1000.0, "09:54"),
    ])
    assert rows_of(metrics.revenue_anomaly(frame, at("10:30"))) == [(13.33, 8.0, 66.7)]


@pytest.mark.parametrize("rows, expected", [
    ([], (None, None, None)),
    ([("1", "a", "PAID", 5.0, "10:10")], (None, 5.0, None)),
    ([("1", "a", "PAID", 5.0, "10:29")], (5.0, None, None)),
    ([("1", "a", "PAID", 5.0, "10:29"), ("2", "a", "FAILED", 5.0, "10:10")], (5.0, 0.0, None)),
    ([("1", "a", "PAID", 5.0, None)], (None, None, None)),
])
def test_anomaly_edges(payments, rows, expected):
    assert rows_of(metrics.revenue_anomaly(payments(rows), at("10:30"))) == [expected]


def test_conversion_against_brute_force(spark, orders, payments):
    """Half of the orders share one id, half of the payments pay it."""
    rng = random.Random(7)
    order_rows = [
        (rng.choice(["hot", f"o{rng.randrange(40)}", None, "hot"]), f"10:{rng.randrange(9):02d}:{i % 60:02d}")
        for i in range(300)
    ]
    pay_rows = [
        (str(i), rng.choice(["hot", f"o{rng.randrange(60)}"]), rng.choice(["PAID", "FAILED"]), 1.0, "11:00")
        for i in range(200)
    ]
    paid = {r[1] for r in pay_rows if r[2] == "PAID"}
    expected = []
    for minute in {r[1][:5] for r in order_rows}:
        ids = {r[0] for r in order_rows if r[1][:5] == minute} - {None}
        n = len(ids & paid)
        expected.append((at(minute), len(ids), n))
    got = metrics.order_conversion(orders(order_rows), payments(pay_rows)).drop("conversion_rate_pct")
    assert rows_of(got) == sorted(expected, key=repr)
