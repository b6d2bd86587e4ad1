import random

import pytest

from paypulse.operators.upsert import distinct_keys, latest_by_key, upsert_latest

from tests.conftest import rows_of


def values(frame):
    return sorted(((r.k, r.v) for r in frame.collect()), key=repr)


def test_latest_by_key(versions):
    frame = versions([
        ("a", "old", "10:00", 1), ("a", "new", "11:00", 2),
        ("b", "first", "10:00", 1), ("b", "second", "10:00", 2),
        ("c", "untimed", None, 1), ("c", "timed", "09:00", 9),
        (None, "x", "10:00", 1), (None, "x", "10:00", 1),
    ])
    assert values(latest_by_key(frame, "k", "load_time", "seq")) == sorted(
        [("a", "new"), ("b", "second"), ("c", "timed"), (None, "x"), (None, "x")], key=repr
    )


def test_distinct_keys_counts_like_latest_by_key(versions):
    frame = versions([("a", "x", "10:00", 1), ("a", "y", None, 2), (None, "x", "10:00", 1), (None, "x", "10:00", 1)])
    assert rows_of(distinct_keys(frame, "k")) == [("a",), (None,), (None,)]
    assert distinct_keys(frame, ["k", "v"]).count() == latest_by_key(frame, ["k", "v"]).count() == 4


def test_upsert_rules(versions):
    target = versions([
        ("tie", "t", "10:00", 0), ("older", "t", "10:00", 0), ("newer", "t", "10:00", 0),
        ("untimed target", "t", None, 0), ("untimed source", "t", "10:00", 0),
        ("alone", "t", "10:00", 0), (None, "t", "10:00", 0), ("nulled", "t", "10:00", 0),
    ])
    source = versions([
        ("tie", "s", "10:00", 0), ("older", "s", "09:00", 0), ("newer", "s", "11:00", 0),
        ("newer", "s0", "10:30", 0), ("untimed target", "s", "10:00", 0),
        ("untimed source", "s", None, 0), ("inserted", "s", "08:00", 0), (None, "s", "11:00", 0),
        ("nulled", None, "11:00", 0), ("inserted null", None, "11:00", 0),
    ])
    got = values(upsert_latest(target, source, "k", "load_time", "seq"))
    assert got == sorted([
        ("tie", "t"), ("older", "t"), ("newer", "s"), ("untimed target", "t"), ("untimed source", "t"),
        ("alone", "t"), ("inserted", "s"), (None, "t"), (None, "s"), ("nulled", None),
        ("inserted null", None),
    ], key=repr)


def test_a_higher_offset_is_newer_at_the_same_time(versions):
    target = versions([("a", "t", "10:00", 5), ("b", "t", "10:00", 5), ("c", "t", None, 5)])
    source = versions([("a", "s", "10:00", 6), ("b", "s", "10:00", 4), ("c", "s", None, 6)])
    assert values(upsert_latest(target, source, "k", "load_time", "seq")) == [("a", "s"), ("b", "t"), ("c", "t")]
    # A target without offsets is replaced by later times only.
    plain = upsert_latest(target.drop("seq"), source, "k", "load_time", "seq")
    assert values(plain) == [("a", "t"), ("b", "t"), ("c", "t")]


def test_upsert_on_two_keys(versions):
    target = versions([("a", "x", "10:00", 1), ("a", "y", "10:00", 1)])
    source = versions([("a", "x", "11:00", 2), ("a", None, "11:00", 2)])
    assert rows_of(upsert_latest(target, source, ["k", "v"]).select("k", "v", "seq")) == sorted(
        [("a", "x", 2), ("a", "y", 1), ("a", None, 2)], key=repr
    )


@pytest.mark.parametrize("seed", range(3))
def test_upserts_in_any_batches_equal_one_fold(spark, versions, seed):
    rng = random.Random(seed)
    rows = [
        (rng.choice("abcde"), str(i), f"{rng.randrange(10, 12)}:00", i) for i in range(40)
    ]
    cuts = sorted(rng.sample(range(1, 40), 2))
    merged = versions([])
    for start, end in zip([0, *cuts], [*cuts, 40]):
        merged = upsert_latest(merged, versions(rows[start:end]), "k", "load_time", "seq")
    assert rows_of(merged) == rows_of(latest_by_key(versions(rows), "k", "load_time", "seq"))


def test_a_key_with_a_third_of_all_rows(spark):
    rows = spark.range(30_000).selectExpr(
        "if(id % 3 = 0, 'hot', cast(id as string)) as k", "id as v",
        "timestamp_ntz '2024-01-01' + make_dt_interval(0, 0, 0, id) as load_time", "id as seq",
    )
    got = latest_by_key(rows, "k", "load_time", "seq")
    assert got.count() == 20_001
    assert got.where("k = 'hot'").first().v == 29_997
